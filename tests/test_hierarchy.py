import random

import pytest

from labelops.operators import hierarchy, metrics
from labelops.vocab import HIERARCHY, NODES, closure, hierarchy_edges


def above(edges):
    out = {n: {n} for edge in edges for n in edge if n is not None}
    changed = True
    while changed:
        changed = False
        for parent, child in edges:
            if parent is not None and not out[parent] <= out[child]:
                out[child] |= out[parent]
                changed = True
    return out


def test_closure_of_the_given_hierarchy(spark):
    rows = hierarchy.ancestor_table(hierarchy_edges(spark)).collect()
    assert {(r.node, r.ancestor) for r in rows} == {(n, a) for n in NODES for a in closure(n)}
    assert hierarchy_edges(spark).count() == sum(map(len, HIERARCHY.values()))


def test_two_hundred_nodes(spark):
    rng = random.Random(1)
    edges = [(None, "n0")] + [(f"n{rng.randrange(k)}", f"n{k}") for k in range(1, 200) for _ in range(2)]
    edges += [("n150", "n150"), ("c1", "c2"), ("c2", "c1")]
    expected = above(edges)
    table = hierarchy.ancestor_table(spark.createDataFrame(edges, "parent string, child string"))
    masks = hierarchy.node_words(table)
    assert {len(r.words) for r in masks.collect()} == {4}
    labels = [[rng.choice(list(expected)) for _ in range(rng.randrange(5))] for _ in range(60)]
    pairs = [(k, labels[k], labels[-k - 1]) for k in range(60)]
    aligned = spark.createDataFrame(pairs, "id long, gold array<string>, predicted array<string>")
    united = lambda names: set().union(*[expected[n] for n in names])
    for r in hierarchy.with_ancestors(aligned, table, "gold").collect():
        assert r.nodes == sorted(united(r.gold))
    got = hierarchy.hierarchical_counts(aligned, masks).first()
    sets = [(united(g), united(p)) for _, g, p in pairs]
    assert tuple(got) == (sum(len(g & p) for g, p in sets), sum(len(p) for _, p in sets), sum(len(g) for g, _ in sets))
    scores = metrics.hierarchical_scores(aligned, masks=masks).first()
    assert scores.prec_h == pytest.approx(got.tp / got.n_pred)


def test_unknown_labels_and_empty_hierarchy(spark):
    table = hierarchy.ancestor_table(spark.createDataFrame([("a", "b")], "parent string, child string"))
    row = spark.createDataFrame([(["b", "x"],)], "labels array<string>")
    with pytest.raises(Exception, match="outside the hierarchy: x"):
        hierarchy.with_ancestors(row, table).collect()
    with pytest.raises(Exception, match="outside the hierarchy: x"):
        hierarchy.with_label_words(row, hierarchy.node_words(table), {"bits": "labels"}).collect()
    empty = hierarchy.ancestor_table(spark.createDataFrame([], "parent string, child string"))
    assert empty.count() == 0 and hierarchy.node_words(empty).count() == 0
