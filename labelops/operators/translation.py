"""Translations that are made once per text and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.operators.models import Translator, translate
from labelops.session import stored
from labelops.sources.io import path_exists

SCHEMA = "hash STRING, translation STRING"


class TranslationStore:
    """Table of translations by content hash, one per direction.

    Every distinct text is translated once, however many rows hold it and
    however many runs ask for it. A run appends what it translated in one
    committed write; an interrupted run leaves nothing, and two runs at a time
    may translate a text twice but never give a row twice.
    """

    def __init__(self, spark: SparkSession, path: str, make_translator: Callable[[], Translator]):
        self.spark, self.path, self.make_translator = spark, path, make_translator

    def table(self) -> DataFrame:
        """(hash, translation), one row per text."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        kept = self.spark.read.schema(SCHEMA).parquet(self.path)
        return kept.groupBy("hash").agg(F.min("translation").alias("translation"))

    def add(self, df: DataFrame, text: str) -> None:
        """Translate the texts of a column that the store lacks."""
        self._add(df.select(_hash(text), F.col(text).alias("translation")))

    def _add(self, rows: DataFrame) -> None:
        """The same for rows of (hash, text)."""
        texts = rows.where(F.col("translation").isNotNull()).groupBy("hash").agg(F.first("translation").alias("translation"))
        new = texts.join(self.table().select("hash"), "hash", "left_anti") if path_exists(self.spark, self.path) else texts
        translate(new, self.make_translator, "translation").write.mode("append").parquet(self.path)

    def translate(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Replace a text column by its translation; null stays null, and rows stay as they are.

        The join is by hash; a text that very many rows share makes a skewed
        partition, which adaptive execution splits.
        """
        # Read twice, for what the store lacks and for the rows themselves: stored, so that the plan before runs once.
        rows = stored(df.withColumn("__hash", _hash(text)), "to-translate")
        self._add(rows.select(F.col("__hash").alias("hash"), F.col(text).alias("translation")))
        found = rows.join(self.table().withColumnRenamed("hash", "__hash"), "__hash", "left")
        return found.withColumn(text, F.col("translation")).select(*df.columns)


def _hash(text: str):
    return F.sha2(F.col(text), 256).alias("hash")


def back_translate(df: DataFrame, there: TranslationStore, back: TranslationStore, text: str = "processed_text") -> DataFrame:
    """Through a pivot language and back, both ways from stores."""
    return back.translate(there.translate(df, text), text)
