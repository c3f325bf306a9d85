"""Control over how often an expression is worked out."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(**columns: Column) -> Column:
    """These columns as one generated row: the optimizer does not merge an expression into what is built on it."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
