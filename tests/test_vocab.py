from labelops import vocab
from labelops.vocab import DISPLAY_ORDER, HIERARCHY, LABELS, NODES, closure, label_table, parents


def test_sizes_of_the_hierarchy():
    edges = [(p, c) for p, children in HIERARCHY.items() for c in children]
    leaves = [n for n in NODES if n not in HIERARCHY]
    assert len(edges) == 36 and len(NODES) == 30 and len(leaves) == 22
    assert set(LABELS) <= set(leaves)
    two_parents = {n for n in NODES if len(parents(n)) + (n in HIERARCHY[None]) == 2}
    assert two_parents == {
        "Bandwagon", "Appeal to authority", "Flag-waving", "Appeal to fear/prejudice", "Whataboutism", "Transfer",
    }


def test_label_order():
    assert list(LABELS) == sorted(LABELS) and len(LABELS) == 20
    assert sorted(DISPLAY_ORDER) == sorted(LABELS)


def test_closures():
    assert closure("Smears") == {"Smears", "Ad Hominem", "Ethos"}
    assert closure("Whataboutism") == {"Whataboutism", "Distraction", "Reasoning", "Logos", "Ad Hominem", "Ethos"}
    assert closure("Appeal to authority") == {"Appeal to authority", "Justification", "Logos", "Ethos"}
    cliche = "Thought-terminating cliché"
    assert closure(cliche) == {cliche, "Simplification", "Reasoning", "Logos"}
    assert closure("Transfer") == {"Transfer", "Ethos", "Pathos"}
    assert closure("Logos") == {"Logos"}


def test_label_table(spark):
    rows = label_table(spark).orderBy("pos").collect()
    assert [r["label"] for r in rows] == list(LABELS)
    assert [r["display_rank"] for r in rows] == [DISPLAY_ORDER.index(v) + 1 for v in LABELS]


def test_sql_string_escapes(spark):
    text = "it's a \\ backslash"
    assert spark.sql(f"SELECT {vocab.sql_string(text)}").first()[0] == text
