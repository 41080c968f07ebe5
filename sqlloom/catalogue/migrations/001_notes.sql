CREATE TABLE kinds (kind TEXT PRIMARY KEY, urgent INTEGER NOT NULL CONSTRAINT boolean CHECK (urgent IN (0, 1))) STRICT;
CREATE TABLE notes (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, kind TEXT NOT NULL REFERENCES kinds (kind), tags TEXT DEFAULT '[]', closed INTEGER NOT NULL DEFAULT 0);
