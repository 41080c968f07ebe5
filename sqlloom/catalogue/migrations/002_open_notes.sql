CREATE VIEW open_notes (name, kind, tags) AS SELECT name, kind, tags FROM notes WHERE closed = 0;
INSERT INTO kinds (kind, urgent) VALUES ('plain', false), ('urgent', true);
