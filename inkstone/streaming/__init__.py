"""inkstone: streaming."""
