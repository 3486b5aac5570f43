"""Row identity and size-checked joins that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.session import materialise

LAST = (1 << 63) - 1


def doc_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """(doc_id with null last, hash of the text): tells rows of one doc_id with different texts apart."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(LAST)), F.xxhash64(docs[text_col])


def sized_join(left: DataFrame, right: DataFrame, on, how: str, most_rows: int = 500_000) -> DataFrame:
    """Joins with ``right`` broadcast when it has at most so many (narrow) rows, and with a shuffle beyond that.

    ``right`` is written to the shared folder first, so that counting it doesn't compute it twice."""
    right = materialise(right, "side")
    n = right.count()
    return left.join(F.broadcast(right) if n <= most_rows else right.hint("merge"), on, how)
