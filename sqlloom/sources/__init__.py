"""Where tables, statements, views and settings come from."""
