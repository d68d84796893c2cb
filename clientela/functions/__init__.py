"""Column expressions and small aggregated-frame helpers."""
