"""The registered queries: which table each operator reads, and its check in SQL."""
