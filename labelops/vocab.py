"""Label vocabulary, display order and label hierarchy.

Everything here is small and fixed (20 labels, 30 hierarchy nodes), so it is
kept as Python constants that become literals inside Spark expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 20 text labels, in sorted order (this is the vector order).
LABELS = (
    "Appeal to authority",
    "Appeal to fear/prejudice",
    "Bandwagon",
    "Black-and-white Fallacy/Dictatorship",
    "Causal Oversimplification",
    "Doubt",
    "Exaggeration/Minimisation",
    "Flag-waving",
    "Glittering generalities (Virtue)",
    "Loaded Language",
    "Misrepresentation of Someone's Position (Straw Man)",
    "Name calling/Labeling",
    "Obfuscation, Intentional vagueness, Confusion",
    "Presenting Irrelevant Data (Red Herring)",
    "Reductio ad hitlerum",
    "Repetition",
    "Slogans",
    "Smears",
    "Thought-terminating cliché",
    "Whataboutism",
)

# The same labels by abundance, used to order reports.
DISPLAY_ORDER = (
    "Smears",
    "Loaded Language",
    "Name calling/Labeling",
    "Appeal to authority",
    "Black-and-white Fallacy/Dictatorship",
    "Slogans",
    "Flag-waving",
    "Thought-terminating cliché",
    "Glittering generalities (Virtue)",
    "Exaggeration/Minimisation",
    "Doubt",
    "Appeal to fear/prejudice",
    "Repetition",
    "Whataboutism",
    "Causal Oversimplification",
    "Bandwagon",
    "Reductio ad hitlerum",
    "Misrepresentation of Someone's Position (Straw Man)",
    "Presenting Irrelevant Data (Red Herring)",
    "Obfuscation, Intentional vagueness, Confusion",
)

# Children of every inner node; None is the root, which never
# counts as a label. Some nodes have two parents.
HIERARCHY = {
    None: ("Logos", "Ethos", "Pathos"),
    "Logos": (
        "Repetition",
        "Obfuscation, Intentional vagueness, Confusion",
        "Reasoning",
        "Justification",
    ),
    "Justification": (
        "Slogans",
        "Bandwagon",
        "Appeal to authority",
        "Flag-waving",
        "Appeal to fear/prejudice",
    ),
    "Reasoning": ("Simplification", "Distraction"),
    "Simplification": (
        "Causal Oversimplification",
        "Black-and-white Fallacy/Dictatorship",
        "Thought-terminating cliché",
    ),
    "Distraction": (
        "Misrepresentation of Someone's Position (Straw Man)",
        "Presenting Irrelevant Data (Red Herring)",
        "Whataboutism",
    ),
    "Ethos": (
        "Appeal to authority",
        "Glittering generalities (Virtue)",
        "Bandwagon",
        "Ad Hominem",
        "Transfer",
    ),
    "Ad Hominem": (
        "Doubt",
        "Name calling/Labeling",
        "Smears",
        "Reductio ad hitlerum",
        "Whataboutism",
    ),
    "Pathos": (
        "Exaggeration/Minimisation",
        "Loaded Language",
        "Appeal to (Strong) Emotions",
        "Appeal to fear/prejudice",
        "Flag-waving",
        "Transfer",
    ),
}

# The two classes of the binary task.
BINARY_CLASSES = ("non_propagandistic", "propagandistic")

# All hierarchy nodes without the root, sorted so that a node's bit is stable.
NODES = tuple(sorted({child for children in HIERARCHY.values() for child in children}))


def parents(node: str) -> list[str]:
    """Direct parents of a node, root left out."""
    return [p for p, children in HIERARCHY.items() if p is not None and node in children]


def closure(node: str) -> frozenset[str]:
    """The node and everything above it, root left out."""
    found = {node}
    for parent in parents(node):
        found |= closure(parent)
    return frozenset(found)


def node_bit(node: str) -> int:
    return 1 << NODES.index(node)


def closure_mask(node: str) -> int:
    """Closure of a node as a bit set over NODES."""
    return sum(node_bit(n) for n in closure(node))


def sql_string(value: str) -> str:
    """A text as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: Sequence[str]) -> str:
    return "array(" + ", ".join(sql_string(v) for v in values) + ")"


def label_array(labels: Sequence[str] = LABELS) -> Column:
    return F.expr(sql_array(labels))


def label_at(position: Column | str, labels: Sequence[str] = LABELS) -> Column:
    """Label name at a vector position; a literal lookup, so no join is needed."""
    position = F.col(position) if isinstance(position, str) else position
    return F.element_at(label_array(labels), position + 1)


def display_rank(label: Column | str) -> Column:
    """1-based rank of a label in report order, 0 for an unknown label."""
    label = F.col(label) if isinstance(label, str) else label
    return F.array_position(label_array(DISPLAY_ORDER), label).cast("int")


def label_table(spark: SparkSession) -> DataFrame:
    """Vocabulary as a table (pos, label, display_rank); 20 rows."""
    return (
        spark.range(1)
        .select(F.posexplode(label_array()).alias("pos", "label"))
        .withColumn("display_rank", display_rank("label"))
    )


def hierarchy_edges(spark: SparkSession) -> DataFrame:
    """The hierarchy as a table (parent, child); the root is null."""
    return spark.createDataFrame([(p, c) for p, children in HIERARCHY.items() for c in children], "parent string, child string")
