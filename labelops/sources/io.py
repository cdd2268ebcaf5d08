"""Reading annotated examples, predictions, thresholds and metric tables; writing them.

All readers use explicit schemas, and ids are always strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from labelops.arrow import text_slices
from labelops.operators.reshape import union_all
from labelops.vocab import LABELS


def _text_fields(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


ANNOTATED = StructType([*_text_fields("id", "text", "link", "image"), StructField("labels", ArrayType(StringType()))])
BINARY = StructType(_text_fields("id", "text", "image", "label"))
PREDICTED = StructType([*_text_fields("id"), StructField("labels", ArrayType(StringType()))])
LABEL_METRICS = StructType(
    [
        StructField("index", IntegerType()),
        StructField("label", StringType()),
        StructField("roc_auc", DoubleType()),
        StructField("ap", DoubleType()),
    ]
)
RUN_METRICS = StructType(
    [StructField("index", IntegerType()), StructField("name", StringType()), StructField("value", DoubleType())]
)

# Texts hold quotes, line breaks and outer blanks; all must survive.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(hadoop_path)


def _read_json(spark: SparkSession, path: str | Sequence[str], schema: StructType, json_array: bool) -> DataFrame:
    """JSON arrays are parsed a whole file per task; JSON lines are split freely."""
    paths = path if isinstance(path, str) else list(path)
    return spark.read.schema(schema).option("multiLine", json_array).json(paths)


def read_annotated(spark: SparkSession, path: str | Sequence[str], json_array: bool = True) -> DataFrame:
    """Annotated or unlabelled examples: (id, text, link, image, labels)."""
    return _read_json(spark, path, ANNOTATED, json_array)


def read_language_folders(spark: SparkSession, path: str, json_array: bool = True) -> DataFrame:
    """All languages of a folder with one subfolder ``lang=...`` each, in one read."""
    tagged = StructType([*ANNOTATED.fields, *_text_fields("lang")])
    return _read_json(spark, path, tagged, json_array)


def read_binary(spark: SparkSession, path: str | Sequence[str], json_array: bool = True) -> DataFrame:
    return _read_json(spark, path, BINARY, json_array)


def read_checked(
    spark: SparkSession, path: str, schema: StructType = PREDICTED, json_array: bool = True
) -> DataFrame:
    """Records with their text in ``_corrupt_record`` where they cannot be parsed."""
    permissive = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return (
        spark.read.schema(permissive)
        .option("multiLine", json_array)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )


def read_by_language(spark: SparkSession, paths: Mapping[str, str], json_array: bool = True) -> DataFrame:
    """One file or folder per language, tagged with ``lang``."""
    return union_all(
        [read_annotated(spark, p, json_array).withColumn("lang", F.lit(lang)) for lang, p in paths.items()]
    )


def read_predictions(spark: SparkSession, path: str | Sequence[str], json_array: bool = True) -> DataFrame:
    return _read_json(spark, path, PREDICTED, json_array)


def read_model_predictions(
    spark: SparkSession, paths: Mapping[tuple[str, str], str], json_array: bool = True
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Predictions of all (model, train_set) pairs whose path exists, and these pairs."""
    found = [run for run, path in paths.items() if path_exists(spark, path)]
    if not found:
        raise FileNotFoundError("none of the prediction files exists")
    tables = [
        read_predictions(spark, paths[model, train_set], json_array)
        .withColumn("model", F.lit(model))
        .withColumn("train_set", F.lit(train_set))
        for model, train_set in found
    ]
    return union_all(tables), found


def prepared_schema(vocabulary: Sequence[str] = LABELS) -> StructType:
    """Prepared training table: texts, one 0/1 column per label, cleaned text."""
    flags = [StructField(v, IntegerType()) for v in vocabulary]
    return StructType([*_text_fields("id", "text", "link"), *flags, *_text_fields("processed_text")])


def read_prepared_csv(
    spark: SparkSession, path: str | Sequence[str], vocabulary: Sequence[str] = LABELS
) -> DataFrame:
    """Prepared table from CSV; an empty cleaned text comes back as ''."""
    table = spark.read.schema(prepared_schema(vocabulary)).options(**CSV_OPTIONS).csv(path)
    return table.fillna("", ["processed_text"])


def read_thresholds(spark: SparkSession, path: str, **tags: str) -> DataFrame:
    """A JSON object label -> cut-off as (tags, label, threshold)."""
    text = spark.read.text(path, wholetext=True)
    cuts = F.from_json("value", MapType(StringType(), DoubleType()))
    table = text.select(F.explode(cuts).alias("label", "threshold"))
    return table.select(*[F.lit(v).alias(k) for k, v in tags.items()], "label", "threshold")


def read_threshold_folders(spark: SparkSession, path: str, tag: str = "model") -> DataFrame:
    """The cut-off objects of all subfolders ``model=...``, one file each, in one read."""
    schema = StructType(_text_fields("value", tag))
    text = spark.read.schema(schema).option("wholetext", True).text(path)
    cuts = F.from_json("value", MapType(StringType(), DoubleType()))
    return text.select(tag, F.explode(cuts).alias("label", "threshold"))


def read_threshold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Many threshold objects, one JSON line per model: (model, label, threshold)."""
    schema = StructType(
        [StructField("model", StringType()), StructField("thresholds", MapType(StringType(), DoubleType()))]
    )
    return spark.read.schema(schema).json(path).select("model", F.explode("thresholds").alias("label", "threshold"))


def _with_run(df: DataFrame, pattern: str) -> DataFrame:
    """Tag rows with model, train_set and split taken from the file name."""
    name = F.url_decode(F.input_file_name())
    tagged = df.withColumn("file", name)
    for i, part in enumerate(("model", "train_set", "split"), start=1):
        tagged = tagged.withColumn(part, F.regexp_extract("file", pattern, i))
    return tagged.drop("file")


# File layout <model>/<train set>/eval/<split>_set_<table>.csv.
RUN_FILE = r"([^/]+/[^/]+)/([^/]+)/eval/([a-z]+)_set_"


def read_label_metrics(spark: SparkSession, path: str | Sequence[str], pattern: str = RUN_FILE) -> DataFrame:
    """Per-label metric files of many runs: (label, roc_auc, ap, model, train_set, split)."""
    table = spark.read.schema(LABEL_METRICS).options(**CSV_OPTIONS).csv(path)
    return _with_run(table, pattern).drop("index")


def read_run_metrics(spark: SparkSession, path: str | Sequence[str], pattern: str = RUN_FILE) -> DataFrame:
    """Evaluation summaries of many runs: (name, value, model, train_set, split)."""
    table = spark.read.schema(RUN_METRICS).options(**CSV_OPTIONS).csv(path)
    return _with_run(table, pattern).drop("index")


def read_label_list(spark: SparkSession, path: str) -> DataFrame:
    """One label per line, outer blanks removed, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("label")).filter(F.length("label") > 0)


def _mode(skip_existing: bool) -> str:
    return "ignore" if skip_existing else "overwrite"


def write_prepared_csv(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    df.write.mode(_mode(skip_existing)).options(**CSV_OPTIONS).csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), skip_existing: bool = False) -> None:
    """Parquet, optionally one folder per value of the given columns."""
    writer = df.write.mode(_mode(skip_existing))
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, by: Sequence[str] = (), skip_existing: bool = False) -> None:
    writer = df.write.mode(_mode(skip_existing))
    (writer.partitionBy(*by) if by else writer).json(path)


def write_json_array(df: DataFrame, path: str, by: Sequence[str] = (), skip_existing: bool = False) -> None:
    """JSON files that hold one array each, optionally in one folder per value of the given columns.

    A task writes its rows as they come, a record a line and some at a time, so
    no array is ever held whole. With folders the rows are dealt to tasks by folder first, and a
    folder is a single array: fit for many folders of moderate size.
    """
    record = df.select(F.to_json(F.struct(*[c for c in df.columns if c not in by])).alias("value"), *by)
    if by:
        record = record.repartition(*by).sortWithinPartitions(*by)
    width = len(by)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, opened = None, False
        for batch in (b.slice(*at) for b in batches for at in text_slices(b.column(0))):
            out: list[tuple] = []
            for value, *key in zip(*[c.to_pylist() for c in batch.columns]):
                if opened and key != folder:
                    out.append(("]", *folder))
                    opened = False
                out.append(("," + value if opened else "[" + value, *key))
                folder, opened = key, True
            yield _columns(out, batch.schema)
        if opened:
            yield _columns([("]", *folder)], schema)
        elif not width:
            yield _columns([("[]",)], schema)

    def _columns(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), like)] if rows else [pa.array([], f.type) for f in like], schema=like)

    schema = to_arrow_schema(record.schema)
    writer = record.mapInArrow(lines, record.schema).write.mode(_mode(skip_existing))
    (writer.partitionBy(*by) if by else writer).text(path)


def write_predictions(df: DataFrame, path: str, by: Sequence[str] = (), skip_existing: bool = False) -> None:
    """Predictions as JSON lines of id and labels."""
    table = df.select(F.col("id").cast("string").alias("id"), "labels", *by)
    write_json_lines(table, path, by, skip_existing)


def write_thresholds(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """Cut-offs (model, label, threshold) as one JSON line per model."""
    entries = F.map_from_entries(F.sort_array(F.collect_set(F.struct("label", "threshold"))))
    write_json_lines(df.groupBy("model").agg(entries.alias("thresholds")), path, (), skip_existing)


def write_threshold_folders(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """Cut-offs (model, label, threshold) as one JSON object per model, each in its folder."""
    entries = F.map_from_entries(F.sort_array(F.collect_set(F.struct("label", "threshold"))))
    table = df.groupBy("model").agg(F.to_json(entries).alias("value"))
    # A folder holds one object, however the rows are dealt.
    table.write.mode(_mode(skip_existing)).partitionBy("model").text(path)


def read_metrics(spark: SparkSession, path: str, by: Sequence[str] = ("model", "train_set", "split")) -> DataFrame:
    """Metric tables of all runs of a folder, tagged by its subfolders."""
    schema = StructType([*LABEL_METRICS.fields, *_text_fields(*by)])
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path).drop("index")


def write_metrics(df: DataFrame, path: str, by: Sequence[str] = ("model", "train_set", "split")) -> None:
    """Metric tables as CSV, one folder per run."""
    df.write.mode("overwrite").partitionBy(*by).options(**CSV_OPTIONS).csv(path)


def write_translated(df: DataFrame, path: str, skip_existing: bool = False) -> None:
    """A translated copy of an example file: same rows and columns."""
    write_json_lines(df, path, (), skip_existing)
