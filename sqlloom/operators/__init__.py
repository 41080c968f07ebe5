"""Operators that Spark lacks: snapshot tables, DML, semantic layers."""
