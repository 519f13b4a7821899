"""Shared by the tests of the corpus operators."""

from pyspark.sql import functions as F


def extra(rows):
    """The rows with surplus columns whose names the operators might use themselves."""
    names = ["found", "row", "score", "spans", "head", "label", "token", "n", "set_id", "piece", "rank", "extra", "SPANS_row"]
    return rows.withColumns({name: F.lit(f"own {name}") for name in names})
