"""Readers and writers, as round trips of what the tables hold.

Each query writes under the shared scratch folder and returns what it reads
back, so that its result can be compared with the source.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelops.functions.text import clean_text
from labelops.operators import curves, models, reshape, stats, thresholds, validate
from labelops.operators.translation import TranslationStore
from labelops.plans.inputs import MODELS, Inputs, joined
from labelops.plans.metric_queries import LABEL_SWEEP, RUN_CURVE, rounded
from labelops.plans.model_queries import GLOSSARY, glossary_sql
from labelops.plans.registry import query
from labelops.plans.text_queries import clean_ctes
from labelops.session import scratch_path
from labelops.sources import io
from labelops.vocab import LABELS, label_array


@query("s1_read_annotated", "SELECT d.id, d.text, g.labels FROM docs d JOIN gold g ON d.id = g.id")
def annotated(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "annotated")
    io.write_json_array(t.gold.select("id", "text", "labels"), path)
    return joined(io.read_annotated(t.spark, path), "text")


@query("s1_read_annotated_lines", "SELECT d.id, d.text, g.labels FROM docs d JOIN gold g ON d.id = g.id")
def annotated_lines(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "annotated")
    io.write_json_lines(t.gold.select("id", "text", "labels"), path)
    return joined(io.read_annotated(t.spark, path, json_array=False), "text")


@query("s2_read_by_language", "SELECT d.id, d.lang, length(d.text) AS n_chars FROM docs d")
def by_language(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "languages")
    io.write_json_lines(t.gold.select("id", "text", "labels", "lang"), path, by=["lang"])
    read = io.read_language_folders(t.spark, path, json_array=False)
    return read.select("id", "lang", F.length("text").cast("bigint").alias("n_chars"))


def _prepared(t: Inputs) -> DataFrame:
    noisy = t.noisy.join(t.gold.select("id", "labels", F.col("source").alias("link")), "id")
    wide = reshape.one_hot_encode(noisy.drop("lang").withColumn("processed_text", clean_text("text")))
    return wide.select("id", "text", "link", *[reshape.quoted(v) for v in LABELS], "processed_text")


@query(
    "s3_read_prepared_csv",
    "SELECT c.id, c.raw AS text, c.processed_text, g.labels FROM clean c JOIN gold g ON c.id = g.id",
    clean_ctes(),
)
def prepared_csv(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "prepared-csv")
    io.write_prepared_csv(_prepared(t), path)
    return joined(reshape.decode_wide(io.read_prepared_csv(t.spark, path)), "text", "processed_text")


@query("s4_read_model_predictions", "SELECT id, model, train_set, labels FROM preds")
def model_predictions(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "predictions")
    io.write_predictions(t.predictions, path, by=["train_set", "model"])
    paths = {(model, train): f"{path}/train_set={train}/model={model}" for model, train in MODELS}
    paths["absent", "original_train"] = f"{path}/train_set=original_train/model=absent"
    read, _ = io.read_model_predictions(t.spark, paths, json_array=False)
    return joined(read, "model", "train_set")


@query("s5_read_thresholds", "SELECT model, label, round(threshold, 6) AS threshold FROM best", *LABEL_SWEEP)
def read_thresholds(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "thresholds")
    io.write_threshold_folders(thresholds.best_label_thresholds(t.scores), path)
    return rounded(io.read_threshold_folders(t.spark, path), "threshold", digits=6)


@query("s5_read_threshold_lines", "SELECT model, label, round(threshold, 6) AS threshold FROM best", *LABEL_SWEEP)
def read_threshold_lines(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "thresholds")
    io.write_thresholds(thresholds.best_label_thresholds(t.scores), path)
    return rounded(io.read_threshold_lines(t.spark, path), "threshold", digits=6)


RUN_TABLE = """
SELECT c.model, c.train_set, c.data_type, v.label, round(c.roc_auc, 9) AS roc_auc, round(c.ap, 9) AS ap
FROM curve c JOIN vocab v ON c.pos = v.pos"""


def _run_table(t: Inputs) -> DataFrame:
    table = curves.label_metric_table(t.scores, ["model", "train_set", "data_type"])
    return rounded(table, "roc_auc", "ap").select("model", "train_set", "data_type", "label", "roc_auc", "ap")


@query("s6_read_label_metrics", RUN_TABLE, *RUN_CURVE)
def label_metrics(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "label-metrics")
    table = _run_table(t).withColumn("index", F.array_position(label_array(), F.col("label")))
    by = ["model", "train_set", "data_type"]
    io.write_metrics(table.select("index", "label", "roc_auc", "ap", *by), path, by=by)
    pattern = "model=([^/]+)/train_set=([^/]+)/data_type=([^/]+)/"
    read = io.read_label_metrics(t.spark, f"{path}/*/*/*", pattern)
    return read.withColumnRenamed("split", "data_type")


@query("s7_read_label_list", "SELECT DISTINCT label FROM gold_long WHERE y = 1")
def label_list(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "label-list")
    used = stats.label_nodes(t.gold).select(F.explode(F.array(F.concat(F.lit("  "), "label"), F.lit(""))).alias("value"))
    used.write.mode("overwrite").text(path)
    return io.read_label_list(t.spark, path)


@query("s8_write_prepared_table", "SELECT label, CAST(sum(y) AS BIGINT) AS n FROM gold_long GROUP BY label")
def prepared_table(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "prepared")
    io.write_prepared_csv(_prepared(t), path)
    sums = stats.support_wide(io.read_prepared_csv(t.spark, path))
    return sums.unpivot([], [reshape.quoted(v) for v in LABELS], "label", "n")


@query("s9_write_predictions", "SELECT id, model, labels FROM preds")
def predictions(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "predictions")
    io.write_predictions(t.predictions, path, by=["model"])
    schema = "id STRING, labels ARRAY<STRING>, model STRING"
    return joined(t.spark.read.schema(schema).json(path), "model")


@query("s10_write_metric_tables", RUN_TABLE, *RUN_CURVE)
def metric_tables(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "metrics")
    by = ["model", "train_set", "data_type"]
    table = _run_table(t).withColumn("index", F.array_position(label_array(), F.col("label")))
    io.write_metrics(table.select("index", "label", "roc_auc", "ap", *by), path, by=by)
    return io.read_metrics(t.spark, path, by)


@query("s11_overwrite_or_skip", "SELECT id, lang, 'second' AS written FROM docs")
def overwrite_or_skip(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "overwrite")
    rows = t.gold.select("id", "lang")
    io.write_table(rows.withColumn("written", F.lit("first")), path)
    io.write_table(rows.withColumn("written", F.lit("second")), path)
    io.write_table(rows.withColumn("written", F.lit("third")), path, skip_existing=True)
    return t.spark.read.parquet(path)


@query("s12_write_translated", f"SELECT id, lang, {glossary_sql('text')} AS text FROM docs")
def translated(t: Inputs) -> DataFrame:
    path = scratch_path(t.spark, "translated")
    source = t.gold.select("id", "lang", "text")
    store = TranslationStore(t.spark, scratch_path(t.spark, "store"), partial(models.GlossaryTranslator, GLOSSARY))
    io.write_translated(store.translate(source), path)
    return t.spark.read.schema(source.schema).json(path)


@query("v1_malformed_records", "SELECT id, lang = 'fr' AS malformed FROM docs")
def malformed(t: Inputs) -> DataFrame:
    """Records of one language lose their closing brace and must be found again."""
    path = scratch_path(t.spark, "malformed")
    record = F.to_json(F.struct("id", "labels"))
    broken = F.when(F.col("lang") == "fr", F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    t.gold.withColumn("line", record).select(broken.alias("value")).write.mode("overwrite").text(path)
    read = io.read_checked(t.spark, path, json_array=False)
    bad = validate.malformed_records(read)
    name = F.coalesce("id", F.regexp_extract("_corrupt_record", '"id":"([^"]+)"', 1))
    lost = bad.select(name.alias("id"), F.lit(True).alias("malformed"))
    good = read.filter(F.col("_corrupt_record").isNull()).select("id", F.lit(False).alias("malformed"))
    return good.unionAll(lost)
