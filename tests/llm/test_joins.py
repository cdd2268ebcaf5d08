"""N-gram Jaccard join, fingerprints and decontamination against brute force on small tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from labelops.llm import decontaminate, fingerprints, jaccard_join
from labelops.llm.components import components
from labelops.llm.rows import row_id, row_key


def shingles(text, n=5):
    table = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in range(9, 14)}
    words = [w for w in (text or "").translate(table).split(" ") if w]
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, words, size, edits):
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(edits):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(size)] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.fixture
def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    line = " ".join(words[:12])
    texts = [t for size in (3, 5, 8, 20, 60, 120) for t in family(rng, words, size, 12)]
    texts += [" ".join(rng.choice(words) for _ in range(40)) + "\n" + line for _ in range(20)]
    texts += [line, line.upper(), line + " end", None, "", " \t\n ", "one", "One", "one  two", "a b", texts[0], texts[30]]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 4])
def test_join_finds_all_links(table, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0.02)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(corpus)).collect()}
    assert got == groups(corpus)


def test_join_keeps_repeated_and_null_rows(table):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (2, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in jaccard_join.jaccard_join(table(rows)).collect())
    assert got == [(-1, 1, -1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert jaccard_join.jaccard_join(table([])).count() == 0


def test_links_through_null_and_repeated_ids(table):
    words = [f"w{k}" for k in range(60)]
    middle = " ".join(words[:50])
    ends = [" ".join(words[:43]), " ".join(words[7:50])]
    # The two ends are linked only through the middle text, which has no id of its own.
    rows = [(4, ends[0]), (9, ends[1]), (None, middle), (None, middle), (None, "quite other words in this text"), (9, "alone in here as well now"), (0, "zero")]
    assert groups([(4, ends[0]), (9, ends[1])])[9] != groups([(4, ends[0]), (9, ends[1]), (10, middle)])[9]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in jaccard_join.jaccard_join(table(rows)).collect())
    expected = [(False, 0, 1, False, 0), (False, 4, 39, False, 4), (False, 9, 2, False, 9), (False, 9, 39, False, 4)]
    assert got == expected + [(True, 0, 2, True, 0), (True, 0, 46, False, 4), (True, 0, 46, False, 4)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len({roots[k] for k in (1, 2, 3, 8, 9)}) == 1 and roots[4] == roots[5] != roots[1] and 7 not in roots
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_with_edits(table, corpus):
    rows = corpus + [(500, "word " * 3000)]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(table(rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(text), shingles(edited)
        if len(a) > 50:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.12
        assert 0 <= got[i].near_next <= 1
    same = [r.fingerprint for r in got.values() if corpus[0][1] == dict(rows)[r.doc_id]]
    assert len(set(same)) == 1 and got[74].fingerprint == "" if dict(rows)[74] is None else True
    alone = fingerprints.compare_with_edits(table([(3, "a b c")])).collect()
    assert alone[0].near_next == 1.0
    assert fingerprints.compare_with_edits(table([])).count() == 0


def test_leaks(table, spark):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(900)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60)))) for k in range(12)]
    docs, expected = [], set()
    for d in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200)))
        if d % 3 == 0:
            item, passage = items[d % 12]
            text = f"{text}\n{passage.upper() if d % 2 else passage} {text[:40]}"
            expected.add((d, item))
        docs.append((d, text))
    docs += [(100, None), (101, ""), (None, items[0][1])]
    benchmark = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(docs), benchmark).collect()}
    expected.add((None, 0))
    assert got == expected
    clean = decontaminate.decontaminated(table(docs), benchmark)
    assert clean.columns == table(docs).columns
    assert clean.count() == len(docs) - len({d for d, _ in expected})
    without = table([(None, items[1][1]), (None, "clean"), (0, items[1][1] + " more"), (None, None)])
    assert sorted(map(str, (r.text for r in decontaminate.decontaminated(without, benchmark).collect()))) == ["None", "clean"]
    assert decontaminate.find_leaks(table([]), benchmark).count() == 0
    assert decontaminate.find_leaks(table(docs), benchmark.limit(0)).count() == 0


def test_similarity_below_the_limit_is_no_leak(table, spark):
    item = " ".join(f"k{n}" for n in range(40))
    half = " ".join(f"k{n}" for n in range(20)) + " " + " ".join(f"z{n}" for n in range(20))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.find_leaks(table([(1, half)]), benchmark).count() == 0
    assert decontaminate.find_leaks(table([(1, "q r s " + item + " t u")]), benchmark).first()["start_word"] == 3


def test_leaks_of_repeated_rows_and_items(table, spark):
    first, second = (" ".join(f"{c}{n}" for n in range(30)) for c in "ab")
    benchmark = spark.createDataFrame([(1, first), (1, second), (1, second), (2, "c " * 9)], "item_id long, text string")
    docs = table([(1, f"x y {first} z")] * 3 + [(2, second), (2, "other words"), (3, "other words")])
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert got == {(1, 1): (2, 1.0), (2, 1): (0, 1.0)}
    # Only the row with the passage goes.
    assert sorted(r.doc_id for r in decontaminate.decontaminated(docs, benchmark).collect()) == [2, 3]


def test_few_texts_are_moved(table, monkeypatch):
    """Documents that no candidate names stay where they are; those that one names all come through."""
    rows = [(k, f"text {k} has words{k} of its own{k} and more{k} of them{k}") for k in range(3000)] + [(None, "no id at all here"), (7, None)]
    docs = table(rows).select(row_id().alias("doc"), "text", row_key().alias("row"))
    keys = docs.where("doc % 100 = 5 or text like 'no id%'").select("doc", "row")
    held = jaccard_join._may_hold(docs, keys)
    assert held.columns == docs.columns
    got = {r.text for r in held.collect()}
    assert {t for k, t in rows if k is None or k % 100 == 5} <= got and len(got) < 40
    assert jaccard_join._may_hold(docs, keys.where("false")).count() == 0
    # With few bits other documents come through as well, and the join has the same result.
    monkeypatch.setattr(jaccard_join, "KEY_BITS", 8)
    assert {t for k, t in rows if k is None or k % 100 == 5} <= {r.text for r in jaccard_join._may_hold(docs, keys).collect()}
    near = [(k, " ".join(f"w{k // 2}x{j}" for j in range(60)) + (" end" if k % 2 else "")) for k in range(20)]
    assert {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_join(table(near)).collect()} == {(k, k - k % 2) for k in range(20)}


def test_bits_tell_long_sets_apart(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = [1, 2, 7, 60, 64, 65, 600, 2040, 2049, 5000, 6000, 6000]
    sets = {k: rng.integers(0, 1 << 63, n).astype(np.uint64) for k, n in enumerate(sizes)}
    # Linked with a set of other bits, as twice as many or folded from them, and by the least overlap.
    for k, n in list(enumerate(sizes))[3:10]:
        least = -(-75 * n // 100)
        sets[100 + k] = sets[k][:least]
        sets[200 + k] = np.concatenate((sets[k], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)))
    assert {jaccard_join.level(n) - jaccard_join.level(-(-75 * n // 100)) for n in range(1, 9000)} <= {0, 1}

    def possible(units):
        rows = [(u, side, k, len(sets[k]), jaccard_join.set_bits(np.unique(sets[k]))) for u, side, k in units]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        batch = pa.RecordBatch.from_arrays(columns, names=["unit", "side", "entity", "n", "bits"])
        out = {}
        for b in jaccard_join._possible(iter([batch])):
            for unit, side, k in zip(*(c.to_pylist() for c in b.columns)):
                out.setdefault(unit, set()).add((side, k))
        return sorted(map(sorted, out.values()))

    together = [[(0, k), (0, 100 + k), (0, 200 + k)] for k in range(3, 10)]
    for most in (17, 8):
        monkeypatch.setattr(jaccard_join, "MOST_BITS", most)
        got = possible([(1, 0, k) for k in sorted(sets)])
        for family in together:
            assert any(set(family) <= set(found) for found in got), family
        if most == 17:
            # Sets that share nothing stay behind, long ones too.
            assert [f for f in got if any(k % 100 >= 6 for _, k in f)] == sorted(f for f in together if f[0][1] >= 6)
    # A pair that meets in several groups is one unit; two sides are compared with each other only.
    monkeypatch.undo()
    assert possible([(u, 0, k) for u in range(4) for k in (9, 10 + u % 2, 109)]) == [[(0, 9), (0, 109)]]
    assert possible([(5, 0, 9), (5, 0, 109), (5, 1, 10)]) == []
    assert possible([(5, 0, 9), (5, 0, 10), (5, 1, 109)]) == [[(0, 9), (1, 109)]]
