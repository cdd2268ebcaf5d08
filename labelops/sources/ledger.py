"""Ledger of finished runs: one committed folder per run, found on storage."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelops.sources.io import path_exists

RUN = ("model", "train_set")


class RunLedger:
    """Metric tables of runs under ``path/model=.../train_set=...``.

    A run counts as finished once its folder holds the marker that a write
    leaves when it is complete; what an interrupted run left is overwritten.
    Nothing but the storage is asked, so another session, or the same one after
    a crash, goes on where the runs ended.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def folder(self, model: str, train_set: str) -> str:
        return f"{self.path}/model={quote(model, safe=' ')}/train_set={quote(train_set, safe=' ')}"

    def finished(self, runs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
        """Those of the runs that are finished, in order."""
        return [run for run in runs if path_exists(self.spark, f"{self.folder(*run)}/_SUCCESS")]

    def record(self, model: str, train_set: str, metrics: DataFrame, written_by: str = "") -> None:
        """Commit the metrics of a run; ``written_by`` names who ran it."""
        table = metrics.drop(*RUN).withColumn("written_by", F.lit(written_by))
        table.write.mode("overwrite").parquet(self.folder(model, train_set))

    def table(self, runs: Iterable[tuple[str, str]]) -> DataFrame | None:
        """Metrics of the finished ones of the runs, tagged with model and train_set, from one read."""
        folders = [self.folder(*run) for run in self.finished(runs)]
        if not folders:
            return None
        read = self.spark.read.option("basePath", self.path).parquet(*folders)
        names = [F.col(n).cast("string").alias(n) for n in RUN]
        return read.select(*names, *[c for c in read.columns if c not in RUN])
