"""Curves, sweeps and thresholds against brute force; published hierarchical scores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelops.operators import curves, ensemble, metrics, ranges, reshape, stats, thresholds
from labelops.sources import io
from labelops.vocab import LABELS, NODES, closure



def score_table(spark, seed=3, rows=80, levels=15):
    rng = np.random.default_rng(seed)
    data, table = {}, []
    for model in ("a", "b"):
        y = (rng.random((rows, 20)) < 0.25).astype(int)
        y[:, 4], y[:, 5] = 0, 1
        s = np.round(rng.random((rows, 20)) * 0.6 + 0.4 * y * rng.random((rows, 20)), 3)
        s[:, 7] = 0.5
        s[:, 8] = rng.integers(0, levels, rows) * 0.02
        data[model] = y, s
        table += [(str(i), model, y[i].tolist(), s[i].tolist()) for i in range(rows)]
    return data, spark.createDataFrame(table, "id STRING, model STRING, y ARRAY<INT>, scores ARRAY<DOUBLE>")


def brute_auc(y, s):
    p, n = s[y == 1], s[y == 0]
    if not len(p) or not len(n):
        return None
    return ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def brute_ap(y, s):
    if not y.sum():
        return None
    total, before = 0.0, 0
    for cut in sorted(set(s), reverse=True):
        hit = s >= cut
        tp = (y[hit] == 1).sum()
        total += (tp - before) / y.sum() * tp / hit.sum()
        before = tp
    return total


def f1(y, p):
    tp, fp, fn = ((y == 1) & (p == 1)).sum(), ((y == 0) & (p == 1)).sum(), ((y == 1) & (p == 0)).sum()
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


@pytest.mark.usefixtures("many_runs")
def test_curves_equal_brute_force(spark):
    data, df = score_table(spark)
    rows = curves.label_curve_metrics(df).collect()
    assert len(rows) == 40
    for r in rows:
        y, s = (m[:, r["pos"]] for m in data[r["model"]])
        assert r["support"] == y.sum()
        for got, expected in ((r["roc_auc"], brute_auc(y, s)), (r["ap"], brute_ap(y, s))):
            assert got is None if expected is None else got == pytest.approx(expected, abs=1e-12)


@pytest.mark.usefixtures("many_runs")
def test_one_label_spreads_over_runs(spark):
    """All rows of one group and label: no run may hold the whole of it."""
    df = spark.range(4000).selectExpr("'m' as model", "cast(id % 3 = 0 as int) as y1", "id / 4000.0D as s")
    df = df.select("model", F.array("y1").alias("y"), F.array("s").alias("scores"))
    elements = reshape.score_elements(df)
    runs = ranges.into_runs(elements, ["model", "pos"], [F.col("score").desc()])
    sizes = [r["count"] for r in runs.groupBy("run").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 4000 * 0.75
    got = curves.label_curve_metrics(df).first()
    y, s = np.array([int(i % 3 == 0) for i in range(4000)]), np.arange(4000) / 4000
    assert got["roc_auc"] == pytest.approx(brute_auc(y, s)) and got["ap"] == pytest.approx(brute_ap(y, s))


@pytest.mark.usefixtures("many_runs")
def test_global_rank(spark):
    df = spark.range(1000).withColumn("key", (F.col("id") * 7919) % 1009)
    ranked = ranges.global_rank(df, [F.col("key")]).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, 1001))
    assert [r["key"] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(r["key"] for r in ranked)


def test_weighted_curves(spark):
    data, df = score_table(spark)
    for r in curves.weighted_curve_metrics(df).collect():
        y, s = data[r["model"]]
        support = y.sum(axis=0)
        auc = [brute_auc(y[:, i], s[:, i]) or 0 for i in range(20)]
        ap = [brute_ap(y[:, i], s[:, i]) or 0 for i in range(20)]
        assert r["roc_auc"] == pytest.approx(np.dot(auc, support) / support.sum())
        assert r["ap"] == pytest.approx(np.dot(ap, support) / support.sum())


def test_sweep_equals_brute_force(spark):
    data, df = score_table(spark)
    rows = thresholds.threshold_sweep(df).collect()
    assert len(rows) == 100
    grid = np.arange(0, 1, step=0.02)
    for r in rows:
        y, s = data[r["model"]]
        p = (s >= grid[r["cut"]]).astype(int)
        weights = y.sum(axis=0)
        expected = np.dot([f1(y[:, i], p[:, i]) for i in range(20)], weights) / weights.sum()
        assert r["f1"] == pytest.approx(expected) and r["accuracy"] == pytest.approx((y == p).all(axis=1).mean())
    parts = thresholds.sweep_f1(df).join(thresholds.sweep_accuracy(df).drop("threshold"), ["model", "cut"])
    whole = {(r["model"], r["cut"]): (r["f1"], r["accuracy"]) for r in rows}
    for r in parts.collect():
        assert whole[r["model"], r["cut"]] == pytest.approx((r["f1"], r["accuracy"]))


def test_best_label_thresholds(spark):
    data, df = score_table(spark)
    grid = np.arange(0, 1, step=0.02)
    for r in thresholds.best_label_thresholds(df).collect():
        i = LABELS.index(r["label"])
        y, s = (m[:, i] for m in data[r["model"]])
        both = []
        for cut in grid:
            p = (s >= cut).astype(int)
            both.append((y.sum() * f1(y, p) + (1 - y).sum() * f1(1 - y, 1 - p)) / len(y))
        assert r["f1"] == pytest.approx(max(both))
        assert r["threshold"] == grid[next(k for k, v in enumerate(both) if v >= max(both) - 1e-12)]


def test_apply_thresholds_by_name(spark):
    data, df = score_table(spark)
    cuts = [(m, v, 0.3 + 0.01 * i) for m in ("a", "b") for i, v in enumerate(LABELS)]
    table = spark.createDataFrame(cuts[::-1], "model STRING, label STRING, threshold DOUBLE")
    for r in thresholds.apply_thresholds(df, table).collect():
        s = data[r["model"]][1][int(r["id"])]
        expected = [int(s[i] >= 0.3 + 0.01 * i) for i in range(20)]
        assert r["yhat"] == expected and r["labels"] == [v for v, flag in zip(LABELS, expected) if flag]
    with pytest.raises(Exception, match="no cut-offs: b"):
        thresholds.apply_thresholds(df, table.where("model = 'a'")).collect()
    with pytest.raises(Exception, match="a label has no cut-off"):
        thresholds.apply_thresholds(df, table.where("label <> 'Smears'")).collect()


def test_prediction_metrics(spark):
    data, df = score_table(spark)
    predicted = thresholds.apply_threshold(df, 0.4)
    f1s = {r["model"]: r["f1"] for r in metrics.weighted_f1(predicted).collect()}
    accuracy = {r["model"]: r["accuracy"] for r in metrics.subset_accuracy(predicted).collect()}
    for model, (y, s) in data.items():
        p = (s >= 0.4).astype(int)
        weights = y.sum(axis=0)
        assert f1s[model] == pytest.approx(np.dot([f1(y[:, i], p[:, i]) for i in range(20)], weights) / weights.sum())
        assert accuracy[model] == pytest.approx((y == p).all(axis=1).mean())


def test_correlation_equals_numpy(spark):
    data, df = score_table(spark)
    y = data["a"][0]
    labelled = df.filter("model = 'a'").select("id", F.col("y")).withColumn("labels", stats.L.decode_array("y"))
    rows = stats.label_correlation(labelled).collect()
    assert len(rows) == 400
    with np.errstate(invalid="ignore"):
        expected = np.corrcoef(y.T)
    for r in rows:
        value = expected[LABELS.index(r["label_a"]), LABELS.index(r["label_b"])]
        assert r["pearson"] is None if np.isnan(value) else r["pearson"] == pytest.approx(value)
    assert stats.label_correlation(labelled, lower_only=True).count() == 190


def test_disjoint_labels_give_null(spark):
    gold = spark.createDataFrame([("1", ["Smears"]), ("2", [])], "id STRING, labels ARRAY<STRING>")
    wrong = spark.createDataFrame([("1", ["Slogans"]), ("2", [])], "id STRING, labels ARRAY<STRING>")
    scores = metrics.hierarchical_scores(metrics.align(gold, wrong)).first()
    assert (scores["tp"], scores["f1_h"], scores["prec_h"]) == (0, None, 0.0)
    empty = wrong.withColumn("labels", F.array().cast("array<string>"))
    assert metrics.hierarchical_scores(metrics.align(gold, empty)).first()["prec_h"] is None


@pytest.mark.parametrize(
    "gold, predicted, message",
    [
        ([("1", ["Smears"]), ("2", [])], [("1", ["Smears"])], "not predicted"),
        ([("1", ["Smears"])], [("1", ["Smears"]), ("2", [])], "not in gold"),
        ([("1", ["Smears"])], [("1", None)], "without labels"),
        ([("1", ["Smears"])], [("1", ["nonsense"])], "outside the vocabulary: nonsense"),
        ([("1", ["nonsense"])], [("1", [])], "outside the vocabulary: nonsense"),
        ([("1", ["Smears"])] * 2, [("1", [])], "not there once"),
        ([("1", ["Smears"])], [("1", [])] * 2, "not there once"),
        ([(None, ["Smears"])], [(None, [])], "without labels"),
    ],
)
def test_bad_scoring_input_is_refused(spark, gold, predicted, message):
    schema = "id STRING, labels ARRAY<STRING>"
    aligned = metrics.align(spark.createDataFrame(gold, schema), spark.createDataFrame(predicted, schema))
    with pytest.raises(Exception, match=message):
        metrics.hierarchical_scores(aligned).collect()


def test_every_run_has_every_id(spark):
    gold = spark.createDataFrame([("1", ["Smears"]), ("2", [])], "id STRING, labels ARRAY<STRING>")
    schema = "id STRING, model STRING, labels ARRAY<STRING>"
    rows = [("1", "a", ["Smears"]), ("1", "b", []), ("2", "a", []), ("2", "b", [])]
    scored = metrics.hierarchical_scores(
        metrics.align(gold, spark.createDataFrame(rows, schema), run=["model"], n_runs=2), ["model"]
    )
    assert {r["model"]: r["tp"] for r in scored.collect()} == {"a": 3, "b": 0}
    for wrong in (rows[:3], [*rows[:3], ("2", "a", [])]):
        with pytest.raises(Exception, match="once for each of 2 runs|repeated in a run"):
            metrics.align(gold, spark.createDataFrame(wrong, schema), run=["model"], n_runs=2).collect()


def test_binary_scores(spark):
    rows = [("p", "p")] * 50 + [("n", "p")] * 100
    df = spark.createDataFrame(rows, "gold STRING, predicted STRING")
    scores = metrics.binary_scores(df, ("n", "p")).first()
    assert scores["macro_f1"] == pytest.approx(0.25) and scores["micro_f1"] == pytest.approx(1 / 3)


def test_best_run(spark):
    runs = spark.createDataFrame([("a", 0.1, 1), ("b", 0.4, 2), ("c", 0.3, 3)], "model STRING, ap DOUBLE, k INT")
    assert metrics.best_run(runs).first().asDict() == {"model": "b", "ap": 0.4, "k": 2}
    ties = spark.createDataFrame([("c", 0.4, 1), ("b", 0.4, 2), ("a", None, 3)], "model STRING, ap DOUBLE, k INT")
    assert metrics.best_run(ties).first()["model"] == "b"


def test_values_outside_their_lists_are_refused(spark):
    df = spark.createDataFrame([("n", "x")], "gold STRING, predicted STRING")
    with pytest.raises(Exception, match="class outside the list: x"):
        metrics.binary_scores(df, ("n", "p")).collect()
    other = spark.createDataFrame([("1", "z", ["Smears"])], "id STRING, model STRING, labels ARRAY<STRING>")
    with pytest.raises(Exception, match="model outside the list: z"):
        ensemble.aligned_models(other, ["a"]).collect()
    bad = spark.createDataFrame([("1", ["nonsense"])], "id STRING, labels ARRAY<STRING>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        reshape.one_hot_encode(bad).collect()
    with pytest.raises(ValueError, match="63"):
        stats.L.label_bits("labels", [f"label {i}" for i in range(70)])


def test_inner_nodes_take_part_in_ensembles(spark):
    node = next(n for n in NODES if n not in LABELS)
    df = spark.createDataFrame([("1", "a", [node]), ("1", "b", [])], "id STRING, model STRING, labels ARRAY<STRING>")
    assert ensemble.ensemble_by_union(df).first()["labels"] == [node]


# --- published label files, wherever they are: every pair of files over the same ids is scored

PUBLISHED = {
    (206, 517, 300): (0.50428, 0.39845, 0.68667),
    (157, 517, 285): (0.39152, 0.30368, 0.55088),
    (88, 256, 285): (0.32532, 0.34375, 0.30877),
    (119, 256, 300): (0.42806, 0.46484, 0.39667),
    (105, 300, 285): (0.35897, 0.35000, 0.36842),
    (372, 1050, 777): (0.40722, 0.35429, 0.47876),
}


def test_published_hierarchical_scores(spark, published):
    sets = {}
    for path in published(".json", ".txt"):
        try:
            rows = json.loads(open(path, encoding="utf-8").read())
        except ValueError:
            continue
        if isinstance(rows, list) and rows and all("labels" in r for r in rows):
            sets.setdefault(frozenset(r["id"] for r in rows), []).append(io.read_predictions(spark, path))
    found = {}
    for tables in sets.values():
        for predictions in tables:
            for gold in [*tables, metrics.majority_predictions(predictions, "Smears")]:
                row = metrics.hierarchical_scores(metrics.align(gold, predictions)).first()
                found[row["tp"], row["n_pred"], row["n_gold"]] = tuple(
                    round(row[c], 5) for c in ("f1_h", "prec_h", "rec_h")
                )
    assert {k: found.get(k) for k in PUBLISHED} == PUBLISHED
    assert (130, 100) in {
        (reshape.explode_labels(t).count(), t.count()) for tables in sets.values() for t in tables
    }


def test_hierarchical_counts_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [
        (str(i), [NODES[k] for k in rng.integers(0, 30, rng.integers(0, 4))], [NODES[k] for k in rng.integers(0, 30, 2)])
        for i in range(200)
    ]
    row = metrics.hierarchical_scores(
        spark.createDataFrame(rows, "id STRING, gold ARRAY<STRING>, predicted ARRAY<STRING>")
    ).first()
    filled = [[set().union(*[closure(v) for v in labels]) for labels in r[1:]] for r in rows]
    tp, gold, predicted = sum(len(g & p) for g, p in filled), sum(len(g) for g, _ in filled), sum(len(p) for _, p in filled)
    assert (row["tp"], row["n_gold"], row["n_pred"]) == (tp, gold, predicted)
    assert row["f1_h"] == pytest.approx(2 * tp / (gold + predicted))


def test_majority_baseline_is_the_top_label(spark):
    df = spark.createDataFrame([("1", ["Doubt"]), ("2", ["Doubt", "Smears"]), ("3", [])], "id STRING, labels ARRAY<STRING>")
    assert [r["labels"] for r in metrics.majority_predictions(df).collect()] == [["Doubt"]] * 3


# --- ensembles

def test_union_and_vote(spark):
    table = [
        ("1", "a", ["Smears", "Doubt"]), ("1", "b", ["Smears"]), ("1", "c", []), ("1", "d", ["Slogans", "Slogans"]),
        ("2", "a", []), ("2", "b", []), ("2", "c", []), ("2", "d", []),
    ]
    df = spark.createDataFrame(table, "id STRING, model STRING, labels ARRAY<STRING>")
    union = {r["id"]: r["labels"] for r in ensemble.ensemble_by_union(df).collect()}
    assert union == {"1": ["Doubt", "Slogans", "Smears"], "2": []}
    vote = {r["id"]: r["labels"] for r in ensemble.ensemble_by_vote(df, 4).collect()}
    assert vote == {"1": ["Smears"], "2": []}
    both = {(r["id"], r["ensemble"]): r["labels"] for r in ensemble.both_ensembles(df, 4).collect()}
    assert both["1", "union"] == union["1"] and both["1", "vote"] == vote["1"] and len(both) == 4
    wide = {r["id"]: r["a"] for r in ensemble.aligned_models(df, ["a", "b", "c", "d"]).collect()}
    assert wide == {"1": ["Doubt", "Smears"], "2": []}


def test_unknown_label_is_an_error_in_an_ensemble(spark):
    df = spark.createDataFrame([("1", "a", ["nonsense"])], "id STRING, model STRING, labels ARRAY<STRING>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        ensemble.ensemble_by_union(df).collect()
