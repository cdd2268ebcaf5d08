"""Sampling and balancing against a plain Python run; model hooks."""

import hashlib
from collections import Counter
from functools import partial

import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from labelops.operators import balance, models, reshape
from labelops.vocab import LABELS


def key(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:12], 16)


def source(spark, rows=300):
    table = []
    for i in range(rows):
        labels = [v for p, v in enumerate(LABELS[:6]) if (i * 29 + p * 13) % (p * 6 + 2) == 0]
        table.append((f"{i:05d}", f"text {i}", "link", labels, f"the text {i}"))
    schema = "id STRING, text STRING, link STRING, labels ARRAY<STRING>, processed_text STRING"
    return table, spark.createDataFrame(table, schema)


def python_balance(table, n, seed):
    """The same rules, row by row."""
    support = Counter(v for row in table for v in row[3])
    chosen, made, counts = Counter(), Counter(), Counter()
    for pos in sorted(range(20), key=lambda p: (support[LABELS[p]], p)):
        label = LABELS[pos]
        missing = n - counts[label]
        rows = sorted((r for r in table if label in r[3]), key=lambda r: (key(seed, pos, r[0]), r[0]))
        if missing <= 0 or not rows:
            continue
        taken = rows[:missing]
        for r in taken:
            chosen[r[0]] += 1
            counts.update(r[3])
        rest = n - counts[label] if len(rows) < missing else 0
        if rest > 0:
            if len(rows) >= rest:
                made.update((label, r[4]) for r in rows[:rest])
            else:
                picks = [key(seed, f"draw-{pos}", i) % len(rows) for i in range(rest)]
                made.update((label, rows[k][4]) for k in picks)
            counts[label] = n
    return chosen, made


@pytest.mark.usefixtures("many_runs")
@pytest.mark.parametrize("n", [5, 40, 90])
def test_balance_equals_python(spark, n):
    table, df = source(spark)
    rows = balance.balance(df, n, seed=7).collect()
    originals = Counter(r["id"] for r in rows if not r["id"].startswith("aug-"))
    synthetic = [r for r in rows if r["id"].startswith("aug-")]
    chosen, made = python_balance(table, n, 7)
    assert originals == chosen
    assert Counter((r["labels"][0], r["processed_text"]) for r in synthetic) == made
    assert len({r["id"] for r in synthetic}) == len(synthetic)
    assert all(len(r["labels"]) == 1 and r["text"] == r["link"] == "dummy" for r in synthetic)
    support = Counter(v for r in rows for v in r["labels"])
    assert all(support[v] >= n for v in LABELS[:6]) and not any(support[v] for v in LABELS[6:])


def test_balance_is_repeatable_and_augments(spark):
    _, df = source(spark)
    there, back = (partial(models.GlossaryTranslator, g) for g in ({"the": "el"}, {"el": "THE"}))
    augment = partial(models.back_translate, there=there, back=back)
    first, second = (sorted(map(str, balance.balance(df, 60, 11, augment).collect())) for _ in range(2))
    assert first == second and any("THE text" in row for row in first)
    assert sorted(map(str, balance.balance(df, 60, 12, augment).collect())) != first


def test_reserved_ids(spark):
    _, df = source(spark, 3)
    with pytest.raises(ValueError, match="reserved"):
        balance.balance(df.withColumn("id", F.concat(F.lit("aug-"), "id")), 2, 1)


@pytest.mark.usefixtures("many_runs")
def test_sample_exact(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    expected = sorted((str(i) for i in range(500)), key=lambda i: (key(3, i), i))
    for n in (0, 1, 37, 500, 600):
        assert {r[0] for r in balance.sample_exact(df, n, 3).collect()} == set(expected[:n])


def test_sample_exact_survives_a_bad_cut(spark, monkeypatch):
    monkeypatch.setattr(balance, "_key_cut", lambda wanted, available: 1)
    df = spark.range(50).select(F.col("id").cast("string").alias("id"))
    assert balance.sample_exact(df, 20, 3).count() == 20
    _, rows = source(spark)
    assert balance.balance(rows, 30, 7).count() > 0


def test_hot_id_is_sampled_whole(spark):
    """A third of all rows share one id, hence one sampling key."""
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    assert balance.sample_exact(df, 150, 5).count() == 150


def test_sample_with_replacement(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("id"))
    draws = balance.sample_with_replacement(df, 100, 9).collect()
    assert sorted(r["draw"] for r in draws) == list(range(100))
    order = sorted((str(i) for i in range(40)), key=lambda i: (key(9, i), i))
    assert {r["draw"]: r["id"] for r in draws} == {i: order[key(9, i) % 40] for i in range(100)}


def test_keyword_scorer_and_hooks(spark):
    df = spark.createDataFrame([("1", "the the cat"), ("2", "")], "id STRING, processed_text STRING")
    scorers = {"m": partial(models.KeywordScorer, ["the", "cat"]), "n": partial(models.KeywordScorer, ["dog", "cat"])}
    rows = {(r["id"], r["model"]): r["scores"] for r in models.score_with_models(df, scorers).collect()}
    assert rows["1", "m"] == [2 / 3, 0.5] and rows["1", "n"] == [0.0, 0.5] and rows["2", "m"] == [0.0, 0.0]
    assert models.KeywordScorer(["a"])(pd.Series(["a a b"])) == [[2 / 3]]


def separable(spark, rows=120):
    table = []
    for i in range(rows):
        y = [int(i % 3 == 0), int(i % 2 == 0)]
        text = " ".join((["spam"] if y[0] else ["ham"]) + (["even"] if y[1] else ["odd"]) + [f"w{i % 7}"])
        table.append((text, y, "Train" if i % 5 else "Validation"))
    return spark.createDataFrame(table, "text STRING, y ARRAY<INT>, split STRING")


def test_train_grid_and_early_stop(spark):
    df = separable(spark)
    train = df.filter("split = 'Train'")
    estimators = {"lr": LogisticRegression(maxIter=5), "bayes": models.candidate_estimators()["naive_bayes"]}
    runs = models.run_grid({"all": train}, df, estimators, n_labels=2, finished=[("x", "all")]).collect()
    assert {(r["model"], r["split"]) for r in runs} == {(m, s) for m in estimators for s in ("Train", "Validation")}
    assert all(r["roc_auc"] > 0.5 for r in runs)
    assert models.run_grid({"all": train}, df, estimators, 2, finished=[("lr", "all"), ("bayes", "all")]) is None
    settings = [LogisticRegression(maxIter=k) for k in (3, 3, 3, 3, 3)]
    best, tries = models.train_until_no_gain(train, df, settings, n_labels=2, patience=2)
    assert best is not None and tries.count() == 3
    assert models.training_history(df, best).count() > 0


def test_throughput(spark):
    row = models.throughput(spark.range(16), batch_size=8).first()
    assert row["samples"] == 16 and row["runtime_s"] > 0
    assert row["samples_per_second"] == pytest.approx(16 / row["runtime_s"])


def test_reshape_cast_like_and_tags(spark):
    df = spark.createDataFrame([("1", "2")], "b STRING, a STRING")
    model = spark.createDataFrame([(1, 2)], "a INT, b BIGINT")
    assert reshape.cast_like(df, model).schema == model.schema
    tagged = reshape.tag_splits({"x": df, "y": df})
    assert sorted(r["data_type"] for r in tagged.collect()) == ["x", "y"]


def test_cuts_are_exact_when_prefixes_must_be_looked_into(spark, monkeypatch):
    """With almost no rows told apart at once, boundaries are found by finer and finer prefixes."""
    monkeypatch.setattr("labelops.operators.selection.FEW", 2)
    table, df = source(spark)
    for n in (5, 40):
        originals = Counter(r["id"] for r in balance.balance(df, n, seed=7).collect() if not r["id"].startswith("aug-"))
        assert originals == python_balance(table, n, 7)[0]
    expected = sorted((str(i) for i in range(500)), key=lambda i: (key(3, i), i))
    ids = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert {r[0] for r in balance.sample_exact(ids, 123, 3).collect()} == set(expected[:123])


def test_balance_with_repeated_ids(spark):
    """A third of the rows are copies of one row: labels still end at n exactly where they take less than all."""
    table, _ = source(spark)
    rows = table + [("hot", "text", "link", [LABELS[0]], "hot text")] * 150
    df = spark.createDataFrame(rows, "id STRING, text STRING, link STRING, labels ARRAY<STRING>, processed_text STRING")
    got = balance.balance(df, 100, seed=7).collect()
    support = Counter(v for r in got for v in r["labels"])
    assert all(support[v] >= 100 for v in LABELS[:6])
    assert sorted(map(str, got)) == sorted(map(str, balance.balance(df, 100, seed=7).collect()))
