"""The operators applied to the given tables, with the SQL they are checked against."""
