"""Event processing: the same functions take batch tables and streams."""
