"""The registered queries and, where SQL can express them, the same results as SQL on the given tables."""
