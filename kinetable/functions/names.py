"""Column names as callers give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of exactly this name, also when it holds dots (``observation.state``) or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")
