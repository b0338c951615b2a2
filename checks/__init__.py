"""The operators applied to the given tables, each beside the SQL that says what must come out."""
