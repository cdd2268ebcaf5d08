"""Expressions over label arrays: encoding, decoding and the hierarchy.

An array of labels is given as a SQL expression, usually just its column
name. Work per label goes through one lambda function over the array instead
of one generated branch per vocabulary entry: twenty or thirty branches make
methods that the JVM refuses to compile. What a lambda body reads is bound to
its arguments, as an expression named in the body would run per element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelops.vocab import LABELS, NODES, closure, closure_mask, sql_array, sql_string


def _has(labels: str, name: str) -> str:
    return f"array_contains({labels}, {sql_string(name)})"


def known(labels: str = "labels", vocabulary: Sequence[str] = NODES) -> Column:
    """The array itself; an entry outside the vocabulary is an error."""
    strange = f"array_except({labels}, {sql_array(vocabulary)})"
    refused = _refusal(f"array_join({strange}, ', ', 'NULL')")
    return F.expr(f"if(size({strange}) > 0, {refused}, {labels})")


def _refusal(name: str) -> str:
    return f"raise_error(concat('label outside the vocabulary: ', {name}))"


UNKNOWN = _refusal("coalesce(v, 'NULL')")


def one_hot(labels: str = "labels", vocabulary: Sequence[str] = LABELS) -> list[str]:
    """One 0/1 column per vocabulary entry, as SQL for ``selectExpr``."""
    return [f"cast({_has(labels, v)} as int) as `{v}`" for v in vocabulary]


def indicator(labels: str = "labels", vocabulary: Sequence[str] = LABELS) -> Column:
    """0/1 array in vocabulary order."""
    flags = f"transform({sql_array(vocabulary)}, v -> cast(array_contains(held, v) as int))"
    return F.expr(f"transform(array({labels}), held -> {flags})[0]")


def decode_array(flags: str, vocabulary: Sequence[str] = LABELS, condition: str = "flag = 1") -> Column:
    """Label array, in vocabulary order, of the positions of an array where a condition on ``flag`` holds."""
    pairs = f"zip_with({flags}, {sql_array(vocabulary)}, (flag, v) -> if({condition}, v, ''))"
    return F.expr(f"array_remove({pairs}, '')")


def decode_columns(vocabulary: Sequence[str] = LABELS) -> Column:
    """Label array from one 0/1 column per vocabulary entry."""
    return decode_array("array(" + ", ".join(f"`{v}`" for v in vocabulary) + ")", vocabulary)


def decode_bits(bits: str, vocabulary: Sequence[str] = LABELS) -> Column:
    """Label array from a bit set."""
    masks = "array(" + ", ".join(f"{bits} & {1 << i}L" for i in range(len(vocabulary))) + ")"
    return decode_array(masks, vocabulary, "flag != 0")


def joined(labels: Column | str) -> Column:
    """Sorted labels as one string, for reports and comparisons."""
    return F.array_join(F.sort_array(labels), "|")


def label_counts(bits: str = "bits", size: int = len(LABELS)) -> Column:
    """Aggregate: the rows that hold each label, as an array in vocabulary order.

    Counted from ``label_bits``. A fixed number of counters, so it combines
    before the shuffle whatever the sizes of the groups.
    """
    return F.expr("array(" + ", ".join(f"count_if({bits} & {1 << i}L != 0)" for i in range(size)) + ")")


def _sql_map(entries: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{sql_string(k)}, {v}" for k, v in entries.items()) + ")"


def _bit_set(labels: str, bits: dict[str, int]) -> Column:
    if len(bits) > 63:
        raise ValueError(f"a BIGINT holds sets of up to 63 labels, not {len(bits)}")
    lookup = _sql_map({name: f"{mask}L" for name, mask in bits.items()})
    refused = f"cast({UNKNOWN} as bigint)"
    return F.expr(f"aggregate({labels}, 0L, (bits, v) -> bits | coalesce({lookup}[v], {refused}))")


def label_bits(labels: str = "labels", vocabulary: Sequence[str] = LABELS) -> Column:
    """The set of labels as bits of a BIGINT (up to 63 entries); an unknown label is an error."""
    return _bit_set(labels, {v: 1 << i for i, v in enumerate(vocabulary)})


def node_bits(labels: str = "labels") -> Column:
    """Labels and all their ancestors as bits of a BIGINT.

    Set size is then ``bit_count`` and intersection ``&``, without a shuffle,
    and duplicates within an array count once. An unknown label is an error.
    """
    return _bit_set(labels, {n: closure_mask(n) for n in NODES})


def with_ancestors(labels: str = "labels") -> Column:
    """Labels and all their ancestors as a sorted array; an unknown label is an error."""
    lookup = _sql_map({n: sql_array(sorted(closure(n))) for n in NODES})
    refused = f"cast({UNKNOWN} as array<string>)"
    nodes = f"transform({labels}, v -> coalesce({lookup}[v], {refused}))"
    return F.expr(f"sort_array(array_distinct(flatten({nodes})))")


def unknown_labels(labels: str = "labels", known: Sequence[str] = NODES) -> Column:
    """Entries of the array that are no known label."""
    return F.expr(f"array_except({labels}, {sql_array(known)})")
