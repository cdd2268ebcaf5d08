"""Stages of the pipeline on small tables."""

import corpus_pipeline


def test_near_duplicates_decides_by_row(spark, table):
    words = [" ".join(f"{c}{n}" for n in range(40)) for c in "abcd"]
    rows = [(1, words[0]), (2, words[0] + " end"), (2, words[1]), (3, words[2]), (3, words[2]), (3, words[2] + " end"), (4, ""), (4, "")]
    rows += [(None, words[0]), (None, words[3])]
    docs = table(rows)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    # The two texts of id 3 are one group, of which either may be the first.
    (third,) = [r for r in left if r[0] == 3]
    assert third in rows
    assert [r for r in left if r != third] == sorted([(1, words[0]), (2, words[1]), (4, ""), (4, ""), (None, words[3])], key=repr)
