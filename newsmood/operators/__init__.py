"""Table-in, table-out article operators."""
