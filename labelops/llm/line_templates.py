"""Line dedup by log templates.

A fixed-depth tree sorts lines: the first level is the number of tokens, the
next LEADING levels are the leading tokens. Tokens that hold a digit are
variable fields and stand as ``*`` from the start. A line whose masked form is
held by MIN_DOCS documents recurs. Rows of one doc_id with different texts are
documents of their own; equal rows of one doc_id are one document. A line with fewer than MIN_LITERAL of its
tokens fixed, such as a row of figures, is not masked: it recurs only if equal
lines (but for blanks) do, and is in no template. Other lines that differ in words as well recur as a
template: in a leaf, a token is part of a template only if at least TEMPLATE_DOCS
documents of the leaf have it at that place; what varies there becomes ``*`` too.
A template with at least MIN_LITERAL of its tokens fixed recurs when TEMPLATE_DOCS
documents hold a line of it. Of a recurring form or template the first line (by
doc_id, then place) stays and all others are dropped.

Everything is counted by hashes of lines and tokens; texts move once, to be
joined with the places that are dropped in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.session import stored

LEADING = 3
MIN_DOCS = 2
TEMPLATE_DOCS = 3
MIN_LITERAL = 0.6


def spaced(line: Column) -> Column:
    """A line with single blanks between tokens."""
    return F.when(line.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.trim(F.regexp_replace(line, r"[ \t\x0B\f\r]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """A spaced line with ``*`` for tokens with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", "*")).otherwise(line)


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, row, place, form, exact) of all lines with tokens: the masked line, or the line itself where too little of it is fixed."""
    rows = docs.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = rows.select("doc", "row", "place", spaced(F.col("line")).alias("line")).where("line <> ''")
    rows = rows.select("doc", "row", "place", "line", masked(F.col("line")).alias("masked"))
    # Doubled blanks keep neighbouring tokens from sharing one.
    apart = F.concat(F.lit(" "), F.replace("masked", F.lit(" "), F.lit("  ")), F.lit(" "))
    size = _count(F.col("masked"), " ") + 1
    exact = F.when(F.col("masked") == F.col("line"), F.lit(False)).otherwise(size - _count(apart, " * ") < MIN_LITERAL * size)
    rows = rows.select("doc", "row", "place", "line", "masked", exact.alias("exact"))
    return rows.select("doc", "row", "place", F.when(F.col("exact"), F.col("line")).otherwise(F.col("masked")).alias("form"), "exact")


def _leaf() -> Column:
    """The leaf of a line; an exact one has a leaf of its own, so it meets no other line."""
    count = F.length("form") - F.length(F.replace("form", F.lit(" "), F.lit("")))
    return F.when(F.col("exact"), F.xxhash64(F.lit("exact"), "form")).otherwise(F.xxhash64(count, F.substring_index("form", " ", LEADING)))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc, row, place) of every line to drop, for ``docs`` (doc, row, text); ``row`` tells the texts of a doc apart."""
    lines = _lines(docs).select("doc", "row", "place", _leaf().alias("leaf"), F.xxhash64("form").alias("line"))
    # A document holds a line once here; hot lines are combined before they are dealt.
    held = stored(lines.groupBy("leaf", "line", "doc", "row").agg(F.collect_list("place").alias("places")), "lines")
    forms = held.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("doc").alias("first"))
    leaves = held.select("leaf", "doc", "row").distinct().groupBy("leaf").agg(F.count("*").alias("leaf_docs"))
    forms = stored(forms.join(leaves.where(F.col("leaf_docs") >= MIN_DOCS), "leaf"), "forms")

    # Leaves where some line is in few documents by itself but may belong to a template.
    shared = forms.where(F.col("leaf_docs") >= TEMPLATE_DOCS)
    open_leaves = shared.groupBy("leaf").agg(F.min("docs").alias("least"), F.count("*").alias("n")).where(f"least < {TEMPLATE_DOCS} and n > 1")
    wanted = forms.join(open_leaves.select("leaf"), "leaf", "left_semi").select("leaf", "line", "docs", "first")
    templates = stored(_templates(docs, wanted), "templates")

    plain = forms.where(F.col("docs") >= MIN_DOCS).select("leaf", "line", F.col("line").alias("template"))
    sized = held.join(templates, ["leaf", "line"]).select("leaf", "template", "doc", "row").distinct()
    general = sized.groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= TEMPLATE_DOCS)
    general = templates.join(general.select("leaf", "template"), ["leaf", "template"], "left_semi").select("leaf", "line", "template")
    # A line in a general template goes with it, else with its own masked form.
    chosen = stored(
        general.withColumn("general", F.lit(True))
        .union(plain.withColumn("general", F.lit(False)))
        .groupBy("leaf", "line")
        .agg(F.max_by("template", "general").alias("template")),
        "chosen",
    )
    members = held.join(chosen, ["leaf", "line"]).select("leaf", "template", "doc", "row", F.explode("places").alias("place"))
    keep = members.groupBy("leaf", "template").agg(F.min(F.struct("doc", "row", "place")).alias("kept"))
    return members.join(keep, ["leaf", "template"]).where("struct(doc, row, place) <> kept").select("doc", "row", "place")


def _templates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leaf, line, template) of the wanted distinct lines whose template has enough fixed tokens."""
    places = wanted.select(F.col("first").alias("doc"), "leaf", "line", "docs")
    # Both sides grow with the corpus, so neither is ever broadcast.
    texts = docs.join(places.select("doc").distinct().hint("merge"), "doc", "left_semi")
    lines = _lines(texts).where("not exact").select("doc", "form", _leaf().alias("leaf"), F.xxhash64("form").alias("line"))
    lines = lines.join(places, ["doc", "leaf", "line"]).dropDuplicates(["leaf", "line"])
    tokens = lines.select("leaf", "line", "docs", F.posexplode(F.split("form", " ")).alias("at", "token"))
    tokens = stored(tokens.select("leaf", "line", "docs", "at", F.xxhash64("token").alias("token"), (F.col("token") == "*").alias("any")), "tokens")
    common = tokens.where("not any").groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= TEMPLATE_DOCS)
    fixed = tokens.join(common.select("leaf", "at", "token"), ["leaf", "at", "token"], "left_semi")
    size = tokens.groupBy("leaf", "line").agg(F.count("*").alias("size"))
    shapes = fixed.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("fixed"))
    shapes = shapes.join(size, ["leaf", "line"]).where(F.size("fixed") >= MIN_LITERAL * F.col("size"))
    return shapes.select("leaf", "line", F.xxhash64("fixed").alias("template"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of recurring templates but for the first line of each.

    All columns and rows stay; only ``text`` changes. Lines end at ``\\n``; blank
    lines and lines of white space are no lines of a template and stay. A text
    all of whose lines go becomes empty. A null text stays null. Rows of a
    null doc_id stay as they are. Rows of one doc_id with different texts are
    documents of their own, in an order of their hashes; equal rows of one doc_id
    are one document and keep and lose the same lines.
    """
    return _without(docs).select(docs.columns)


def without_emptied(docs: DataFrame) -> DataFrame:
    """The same, without the documents that lose all their text by it."""
    return _without(docs).where("__places is null or text <> ''").select(docs.columns)


def _without(docs: DataFrame) -> DataFrame:
    id_ = F.col("doc_id").cast("long")
    row = F.xxhash64("text")
    named = docs.select(id_.alias("doc"), row.alias("row"), "text").where("doc is not null and text is not null")
    gone = recurring_lines(named).groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    # The places that stay come from one hash set, and the lines are bound once, so a long text costs its length.
    stay = "array_except(sequence(0, size(lines) - 1), __places)"
    kept = F.expr(f"transform(array(split(text, '\\n')), lines -> array_join(transform({stay}, place -> lines[place]), '\\n'))[0]")
    text = F.when(F.col("__places").isNull(), F.col("text")).otherwise(kept)
    gone = gone.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("places").alias("__places")).hint("merge")
    joined = docs.withColumn("__doc", id_).withColumn("__row", row).join(gone, ["__doc", "__row"], "left")
    return joined.withColumn("text", text)
