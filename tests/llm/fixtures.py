import random

import pytest

#: (doc_id, text, lang, source, n_chars) with nulls, empty, long and repeated rows.
VOICE = "the of and then inter ore tion able ly ing harbour light stone river".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(words):
        out.append("".join(rng.choice(VOICE) for _ in range(rng.randint(1, 3))))
        if i % 11 == 10:
            out[-1] += ".\n" if rng.random() < 0.3 else "."
    return " ".join(out)


def rows() -> list[tuple]:
    found = [(i, prose(i, 20 + 9 * (i % 40)), "en", f"s{i % 3}", 0) for i in range(60)]
    base = prose(1000, 300)
    words = base.split(" ")
    for k in range(12):  # near copies: one word differs
        w = list(words)
        w[20 * k + 7] = f"changed{k}"
        found.append((100 + k, " ".join(w), "en", "s0", 0))
    found += [(200 + k, base, "fr", None, 0) for k in range(5)]
    found += [(210, base.upper(), "fr", "s1", 0)]
    found += [(220, None, None, "s2", None), (221, "", "en", "s2", 0), (222, None, "en", None, 0), (223, " \t\n\x0b\x0c\r ", "en", "s2", 7)]
    found += [(230, "one", "en", "s1", 3), (231, "ONE", "en", "s1", 3), (232, "one two", "en", "s1", 7), (233, "one  two", "en", "s1", 8)]
    found += [(240, "x" * 3000, "en", "s1", 3000), (241, prose(2000, 9000), "de", "s1", 0), (242, "Ünïcode ß ẞ İ   nb sp 日本語テキスト 👩‍👩‍👧 é \x1c\x1d|\x85|", "de", "é", 0)]
    found += [(243, "<|endoftext|> a<|startoftext|>b it's 12345 don't  \n\n  end ", "en", "s1", 0)]
    found += [(250, prose(3000, 100), "en", "s0", 0)] * 3  # repeated rows
    found += [(None, prose(3001, 80), "en", "s0", 0), (None, "", "en", "s0", 0)]
    return found


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Written and read, so that row numbers are those of a file scan."""
    from sqlloom.llm.common import materialize

    return materialize(spark.createDataFrame(rows(), SCHEMA).repartition(3), "fixture").cache()


@pytest.fixture(scope="session")
def data():
    return rows()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(7).alias(c) for c in ("id", "row", "h", "key", "n", "i", "size", "block", "node", "host", "sha", "sigs", "train", "_id", "_hash", "_kept")))
