INSERT OR IGNORE INTO notes (id, name, kind, tags) VALUES (1, 'alpha', 'plain', '["a","b"]');
INSERT OR IGNORE INTO notes (id, name, kind, closed) VALUES (2, 'beta', 'plain', 1), (3, 'gamma', 'urgent', 0);
