"""Keys that tell rows of documents apart whatever their doc_id is.

A row is known by its id, 0 standing for null, and a hash of its text whose
lowest bit says whether the id is null. Neither is ever null itself (but for a
null text), so joins on both lose no rows; only equal texts of one id share a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))


def row_key() -> Column:
    without_id = F.col("doc_id").cast("long").isNull().cast("long")
    return F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(without_id)


def id_of(doc: str = "doc", row: str = "row") -> Column:
    """The doc_id that a key stands for."""
    return F.when(F.col(row).bitwiseAND(F.lit(1)) == 0, F.col(doc))
