"""gitsift: commit-history analytics expressed as Spark DataFrame operators."""
