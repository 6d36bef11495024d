"""What the vector operators share: which rows take part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False))


def dimension(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have; of equally frequent ones the smallest. 0 without vectors."""
    sizes = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes["d"] if sizes else 0
