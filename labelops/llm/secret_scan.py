"""Secret scan: patterns of known forms, and strings of high entropy.

The pattern kinds give the base spans. Further candidates are long strings of
token characters; a window of WINDOW characters slides over each and its Shannon
entropy is kept up to date by the counts of the one character that leaves and
the one that enters. A candidate is a secret if the highest entropy reaches the
threshold of its character class and no allow-list pattern explains it.

All positions are code points. Positions come from the lengths of what lies
between the matches, so the whole scan is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.llm.running import running


def _either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


# The three base kinds.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
#: The look-ahead only spares the alternatives where no keyword can start.
ASSIGN = "(?=[PpSsTtAa])(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
# Runs below the least length are never kept, so they are not matched at all.
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: Bits per character in a window, by class: hexadecimal digits only, or any token characters.
LEAST_BITS = {"hex": 3.0, "base64": 3.7}
# A part of a candidate that looks like words: one letter, one case, or capitalised words in a row.
_WORDS = "(?:[A-Za-z]|[A-Z]{2,24}|[A-Z]?[a-z]{1,24}(?:[A-Z][a-z]{1,24}){0,7})"
#: Candidates that are no secrets: UUIDs, numbers, words joined by marks with a short number, rulers.
#: Other letters, mixed in case or longer than words are, are judged by their entropy.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    f"^[+/_=-]*{_WORDS}(?:[+/_=-]+{_WORDS})*[+/_=-]*[0-9]{{0,4}}$",
)


# Array type of spans.
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _ends(gaps: Column, matches: Column) -> Column:
    """End of each match, from the texts before and between matches."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    add = lambda so_far, size: F.struct((so_far + size).alias("state"), (so_far + size).alias("out"))
    return running(sizes, F.lit(0), add, "int")


def _with_spans(rows: DataFrame, name: str, pattern: str, least: int, group: int = 0, guard: Column | None = None) -> DataFrame:
    """Add the spans of the matches whose group has at least ``least`` characters.

    Each step is a column of its own, so no pattern runs twice over a text.
    """
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if guard is not None:
        found = F.when(guard, found).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("m", found)
    some = F.size("m") > 0
    rated = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col("m")
    rows = rows.withColumns({"r": rated, "g": F.when(some, F.split(text, pattern, -1))})
    spans = F.zip_with(
        F.zip_with("m", "r", lambda m, r: F.struct(m.alias("m"), r.alias("r"))),
        _ends(F.col("g"), F.col("m")),
        lambda x, end: F.struct((end - F.length(x["m"])).alias("start"), F.lit(KINDS.index(name)).alias("kind"), end.alias("end"), x["r"].alias("word")),
    )
    kept = F.filter(spans, lambda s: F.length(s["word"]) >= least)
    return rows.withColumn(name, F.when(some, kept)).drop("m", "r", "g")


def _plain(spans: Column) -> Column:
    return F.coalesce(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])), F.array().cast(SPANS))


def _count(window: Column, char: Column) -> Column:
    return F.length(window) - F.length(F.replace(window, char, F.lit("")))


def _weight(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(word: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits per character, of any window of a string of at least that length."""
    head = F.substring(word, 1, window)
    chars = F.array_distinct(F.filter(F.split(head, ""), lambda c: c != ""))
    first = F.aggregate(chars, F.lit(0.0), lambda total, c: total + _weight(_count(head, c)))

    def slide(state: Column, at: Column) -> Column:
        now = word.substr(at, F.lit(window))
        leaves, enters = word.substr(at, F.lit(1)), word.substr(at + window, F.lit(1))
        out = _count(now, leaves)
        in_ = _count(now, enters) - F.when(leaves == enters, 1).otherwise(0)
        total = state["total"] - _weight(out) + _weight(out - 1) - _weight(in_) + _weight(in_ + 1)
        return F.struct(total.alias("total"), F.least(state["least"], total).alias("least"))

    start = F.struct(first.alias("total"), first.alias("least"))
    steps = F.when(F.length(word) > window, F.sequence(F.lit(1), F.length(word) - window)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, slide, lambda state: F.lit(math.log2(window)) - state["least"] / window)


def _suspicious(word: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | word.rlike(pattern)
    least = F.when(word.rlike("^[0-9a-fA-F]+$"), LEAST_BITS["hex"]).otherwise(LEAST_BITS["base64"])
    return F.when(allowed, False).otherwise(highest_entropy(word) >= least)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    A null text counts as empty; without spans the counts are 0, ``spans`` is
    empty and ``base_sha256`` is that of the empty string. Rows stay as they
    are, repeated ones too; other columns are dropped.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _with_spans(rows, "assign", ASSIGN, ASSIGN_LEAST, 2)
    rows = _with_spans(rows, "access", ACCESS, ACCESS_LEAST, guard=F.contains("text", F.lit("AKIA")))
    rows = _with_spans(rows, "hex", HEX, HEX_LEAST)
    rows = _with_spans(rows, "entropy", CANDIDATE, WINDOW)
    rows = rows.select("doc_id", "entropy", *[_plain(F.col(k)).alias(k) for k in KINDS[:3]])
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    free = F.filter("entropy", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("free", F.when(F.size("entropy") > 0, free))
    extra = F.when(F.size("free") > 0, F.filter("free", lambda s: _suspicious(s["word"])))
    rows = rows.withColumn("extra", _plain(extra))
    return rows.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.size("extra").cast("long").alias("n_entropy"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "extra")).alias("spans"),
    )
