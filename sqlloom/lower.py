"""Parameters: every placeholder style becomes ``:name``."""

from __future__ import annotations

from dataclasses import dataclass

from .text import SqlError, identifier, snake, tokens


@dataclass(frozen=True)
class Placeholder:
    name: str  #: in Python and in the lowered SQL
    slot: int
    spellings: tuple[str, ...]


def lower(sql: str) -> tuple[str, list[Placeholder]]:
    """The SQL with ``:name`` for each placeholder, and these in slot order.

    ``?`` takes the slot after the highest, ``?N`` slot N, a name the next slot
    when it first comes; names are one parameter whatever their prefix or case.
    """
    slots: dict[int, dict] = {}
    by_name: dict[str, int] = {}
    places = []
    for t in tokens(sql):
        if t.kind != "param":
            continue
        if t.text == "?":
            slot = max(slots, default=0) + 1
        elif t.text[0] == "?":
            slot = int(t.text[1:])
            if not 1 <= slot <= 32766:
                raise SqlError(f"{t.text}: slots run from 1 to 32766")
        else:
            key = t.text[1:].lower()
            slot = by_name.setdefault(key, max(slots, default=0) + 1)
        found = slots.setdefault(slot, {"spellings": [], "word": None})
        if t.text not in found["spellings"]:
            found["spellings"].append(t.text)
        if t.text[0] != "?" and not found["word"]:
            found["word"] = t.text[1:]
        places.append((t, slot))
    names: dict[int, str] = {}
    used: set[str] = set()
    for slot in sorted(slots):
        base = identifier(snake(slots[slot]["word"])) if slots[slot]["word"] else f"arg{slot}"
        name, n = base, 2
        while name in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name)
        names[slot] = name
    out, at = [], 0
    for t, slot in places:
        out += [sql[at : t.start], ":" + names[slot]]
        at = t.end
    return "".join(out) + sql[at:], [Placeholder(names[s], s, tuple(slots[s]["spellings"])) for s in sorted(slots)]
