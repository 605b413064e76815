"""A small relational engine on Spark: SQL dialect, versioned tables, transactions, inspection commands."""
