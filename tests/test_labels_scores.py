import numpy as np
import pytest
from pyspark.sql import functions as F

from labelops.functions import labels as L
from labelops.functions import scores as S
from labelops.operators import reshape
from labelops.vocab import LABELS, NODES, closure

ROWS = [
    ("007", ["Smears", "Doubt"]),
    ("a", []),
    ("b", ["Smears", "Smears"]),
    ("c", ["Logos"]),
    ("d", ["Thought-terminating cliché", "no such label"]),
]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame(ROWS, "id STRING, labels ARRAY<STRING>")


def within(df, vocabulary):
    return df.where(F.size(L.unknown_labels("labels", vocabulary)) == 0)


def test_labels_outside_the_vocabulary_are_refused(labelled):
    for column in (L.node_bits(), L.label_bits(), L.with_ancestors(), L.known()):
        with pytest.raises(Exception, match="outside the vocabulary: no such label"):
            labelled.where("id = 'd'").select(column).collect()
    with pytest.raises(Exception, match="outside the vocabulary: Logos"):
        reshape.one_hot_encode(labelled.where("id = 'c'")).collect()


def test_one_hot_round_trip(labelled):
    wide = reshape.one_hot_encode(within(labelled, LABELS))
    assert wide.columns == ["id", *LABELS]
    back = {r["id"]: r["labels"] for r in reshape.decode_wide(wide).collect()}
    assert back == {"007": ["Doubt", "Smears"], "a": [], "b": ["Smears"]}


def test_indicator_and_vector(labelled):
    flags = {r[0]: r[1] for r in labelled.select("id", L.indicator("labels")).collect()}
    assert sum(flags["007"]) == 2 and flags["007"][LABELS.index("Doubt")] == 1
    vector = reshape.one_hot_encode(labelled).select(reshape.label_vector().alias("v"))
    assert vector.schema["v"].dataType.simpleString() == "array<float>"


def test_node_bits_and_ancestors(labelled):
    rows = within(labelled, NODES).select("labels", L.with_ancestors("labels").alias("nodes"), F.bit_count(L.node_bits("labels")).alias("n"))
    for r in rows.collect():
        expected = sorted(set().union(*[closure(v) for v in r["labels"]]))
        assert sorted(r["nodes"]) == expected and r["n"] == len(expected)


def test_explode_keeps_empty(labelled):
    rows = reshape.explode_labels(labelled).collect()
    assert len(rows) == 8 and [r["label"] for r in rows if r["id"] == "a"] == [None]


def test_melt(labelled):
    rows = reshape.melt_labels(reshape.one_hot_encode(within(labelled, LABELS)), ["id"]).collect()
    assert {(r["id"], r["label"]) for r in rows} == {
        ("007", "Smears"), ("007", "Doubt"), ("b", "Smears"),
    }


def test_long_and_wide_scores(spark):
    values = [[float(i) / 20 for i in range(20)], [0.5] * 20]
    y = [[i % 2 for i in range(20)], [0] * 20]
    df = spark.createDataFrame([(str(i), "m", y[i], values[i]) for i in range(2)], "id STRING, model STRING, y ARRAY<INT>, scores ARRAY<DOUBLE>")
    back = {r["id"]: r for r in reshape.wide_scores(reshape.long_scores(df)).collect()}
    assert [back[str(i)]["scores"] for i in range(2)] == values and [back[str(i)]["y"] for i in range(2)] == y


def test_grid_index_equals_comparison(spark):
    grid = np.arange(0, 1, step=0.02)
    values = sorted({*grid, *np.nextafter(grid, 2), *np.nextafter(grid, -1), *np.random.default_rng(1).random(500), -0.5, 1.0, 7.0})
    df = spark.createDataFrame([(float(v),) for v in values], "s DOUBLE")
    got = {r["s"]: r["i"] for r in df.select("s", S.grid_index("s").alias("i")).collect()}
    assert got == {float(v): int((grid <= v).sum()) - 1 for v in values}


def test_grid_values_are_the_same_doubles(spark):
    values = [r[0] for r in spark.range(50).select(S.grid_value(F.col("id"))).orderBy("id").collect()]
    assert values == list(np.arange(0, 1, step=0.02))
    assert 0.8200000000000001 in values


def test_grid_index_of_null(spark):
    assert spark.sql("SELECT cast(null as double) s").select(S.grid_index("s")).first()[0] is None


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.3,), (0.30000001,), (0.2999,)], "s DOUBLE")
    assert [r[0] for r in df.select(S.binarise("s", 0.3)).collect()] == [1, 1, 0]
    assert [r[0] for r in df.select(S.binarise("s", 0.0)).collect()] == [1, 1, 1]


def test_f_beta_is_null_where_undefined(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.0, 0.0), (None, 0.5)], "p DOUBLE, r DOUBLE")
    got = [r[0] for r in df.select(S.f_beta(F.col("p"), F.col("r"))).collect()]
    assert got[0] == pytest.approx(1 / 3) and got[1:] == [None, None]


def test_losses_agree(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, -3.0), (0, 40.0)], "y INT, x DOUBLE")
    for a, b in df.select(S.cross_entropy(F.col("y"), S.sigmoid("x"), 1e-300), S.cross_entropy_from_logit(F.col("y"), F.col("x"))).collect()[:3]:
        assert a == pytest.approx(b)
    assert S.sigmoid("x") is not None
