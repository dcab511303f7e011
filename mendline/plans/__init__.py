"""Named queries over the benchmark tables, and the SQL each must agree with."""
