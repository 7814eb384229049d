"""Detection rules as data: conditions become Columns, a scan evaluates all rules in one pass."""
