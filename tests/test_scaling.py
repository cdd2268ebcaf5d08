"""Steps that run once per row, and memory that does not grow with the texts of a batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelops.functions import text as T
from labelops.operators import models, training
from labelops.operators.translation import TranslationStore, back_translate
from labelops.plans import model_queries
from labelops.plans.inputs import Inputs
from labelops.session import scratch_path
from labelops.sources import io


@pytest.fixture
def counted(spark):
    """A column function that passes a text on, and the number of rows that it was run for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        seen.add(1)
        return text

    return passed.asNondeterministic(), lambda: seen.value


@pytest.fixture
def tables(spark, tmp_path):
    """120 documents, every third one labelled."""
    documents = [(i, f"word{i % 7} other{i % 5} the end{i}", "en", "s", 20) for i in range(120)]
    spark.createDataFrame(documents, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 120, 3)]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(
    "query, cleaned",
    [
        (model_queries.resume_check, 40),
        (model_queries.training_check, 40),
        (model_queries.history_check, 40),
        (model_queries.score_in_batches, 120 + 40),
        (model_queries.batches_check, 120 + 40),
        (model_queries.translate, 120),
        (model_queries.back_translate, 120),
    ],
)
def test_every_text_is_cleaned_once(spark, tables, counted, monkeypatch, query, cleaned):
    passed, seen = counted
    monkeypatch.setattr(model_queries, "clean_text", passed)
    query(Inputs(spark, tables)).collect()
    assert seen() == cleaned


def test_features_of_a_training_set_are_fitted_once(spark, tables, monkeypatch):
    fitted, plain = [], models.prepared_features
    monkeypatch.setattr(models, "prepared_features", lambda train, **k: fitted.append(train) or plain(train, **k))
    estimators = {k: e for k, e in models.candidate_estimators(max_iter=1).items() if k != "logistic_regression"}
    trainers = {name: models.estimator_trainer(e, 2) for name, e in estimators.items()}
    labelled = model_queries._labelled(Inputs(spark, tables))
    ledger = models.RunLedger(spark, scratch_path(spark, "runs"))
    table, trained = models.resume_grid(ledger, {"all": labelled}, labelled, trainers, "data_type")
    assert len(fitted) == 1 and len(trained) == 2 and table.count() == 6


def test_validation_rows_are_prepared_once(spark, counted):
    passed, seen = counted
    rows = spark.createDataFrame([(f"a{i % 3} b", [i % 2]) for i in range(30)], "text STRING, y ARRAY<INT>")
    run = training.train_jointly(rows, 1, max_epochs=3, n_features=64, validation=rows.withColumn("text", passed("text")), patience=9)
    assert len(run.history) == 4 and seen() == 30


def test_back_translation_reads_its_rows_once(spark, tmp_path, counted):
    passed, seen = counted
    rows = spark.createDataFrame([(i, None if i == 3 else f"the house {i % 4}") for i in range(20)], "id INT, text STRING")
    there = TranslationStore(spark, f"{tmp_path}/there", lambda: models.GlossaryTranslator({"the": "la"}))
    back = TranslationStore(spark, f"{tmp_path}/back", lambda: models.GlossaryTranslator({"la": "the"}))
    read = back_translate(rows.withColumn("text", passed("text")), there, back, "text").collect()
    assert sorted(read) == sorted(rows.collect()) and seen() == 20


def _longest(spark, run):
    """The most bytes that a model gets at a time for 40 texts of 200,000 bytes, a null and an empty one."""
    rows = [(i, "x" * 200_000) for i in range(40)] + [(40, ""), (41, None)]
    seen = [r[0] for r in run(spark.createDataFrame(rows, "id INT, text STRING").coalesce(1)).collect()]
    assert len(seen) == 42
    return max(seen)


def test_models_get_slices_of_bounded_bytes(spark):
    def scorer():
        return lambda texts: [[float(texts.str.len().sum())]] * len(texts)

    def translator():
        return lambda texts: [str(int(texts.str.len().sum()))] * len(texts)

    assert _longest(spark, lambda df: models.score_texts(df, scorer, "text").select(F.col("scores")[0])) <= 1 << 20
    assert _longest(spark, lambda df: models.translate(df, translator).select(F.col("text").cast("double"))) <= 1 << 20


def test_an_array_is_written_in_small_batches(spark, tmp_path, monkeypatch):
    taken = []

    class Rows:
        columns = ["text"]

        def select(self, *columns):
            return self

        schema = spark.createDataFrame([], "value STRING").schema

        def mapInArrow(self, lines, schema):
            batch = pa.record_batch({"value": ["x" * 300_000] * 20})
            taken.extend(b.nbytes for b in lines(iter([batch])))
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(io.F, "to_json", lambda column: column)
    io.write_json_array(Rows(), f"{tmp_path}/array")
    assert max(taken) < 1_100_000 and sum(taken) > 6_000_000


def test_word_counts_are_held_in_bounded_slices():
    words = pa.array([[i % 5, i % 5, 7] * 50_000 for i in range(6)] + [[], [1]], pa.list_(pa.int32()))
    found = list(training._counts(words, 8))
    assert [n for _, n, *_ in found] == [1, 1, 1, 1, 1, 3]
    row = np.concatenate([first + r for first, _, r, _, _ in found])
    assert row.tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 7] and sum(c.sum() for *_, c in found) == 900_001


def test_contractions_around_the_mark_of_forms(spark):
    texts = ["it's \x00 don't", "\x00", "\x00it's\x00", "don't", "no form", "", "cant can't've", None]
    read = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", T.expand_contractions("t").alias("t"))
    assert [r["t"] for r in sorted(read.collect())] == ["it is \x00 do not", "\x00", "\x00it is\x00", "do not", "no form", "", "cannot cannot have", None]


def test_rows_are_scored_once(spark, tables):
    plan = model_queries.score_in_batches(Inputs(spark, tables))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
