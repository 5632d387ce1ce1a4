"""Column functions: each takes Columns (or literals) and returns a Column."""
