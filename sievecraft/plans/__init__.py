"""Table schemas, storage and composed reports."""
