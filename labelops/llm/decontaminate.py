"""Benchmark decontamination by SimHash windows.

Every benchmark item has a fingerprint: the signs of 64 sums over its five-word
shingles, weighted by how rare they are in the benchmark. Windows of the length
of an item slide over the documents and are fingerprinted in the same way. Two
fingerprints within RADIUS bits agree wholly in at least one of RADIUS + 1
blocks, so joining on (window length, block number, block value) guarantees all
pairs within the radius. The exact weighted Jaccard similarity of the shingles
then verifies each pair.

A window that shares no shingle with any item has similarity 0 to all of them,
so only windows laid over a shared shingle are fingerprinted, one for each place
the shingle has in an item. That loses nothing and leaves few windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.llm.rows import id_of, row_id, row_key
from labelops.session import stored

WORDS = 5
SIMILARITY = 0.75
BITS = 64
#: Similarity 0.75 means an angle that flips 11 of 64 bits on average, with a deviation of 3.
RADIUS = 20

# A-Z to lower case, the other white space to blanks, in one pass.
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0B\f\r"
TO = "abcdefghijklmnopqrstuvwxyz     "


def with_words(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``words``: what stands between ASCII white space, A-Z lower-cased."""
    rows = rows.withColumn("text", F.translate("text", FROM, TO))
    uneven = F.contains("text", F.lit("  ")) | F.startswith("text", F.lit(" ")) | F.endswith("text", F.lit(" "))
    rows = rows.withColumn("text", F.when(uneven, F.trim(F.regexp_replace("text", " +", " "))).otherwise(F.col("text")))
    none = F.array().cast("array<string>")
    return rows.withColumn("words", F.when(F.col("text") == "", none).otherwise(F.split("text", " "))).drop("text")


def shingles(tokens: Column) -> Column:
    """Hashes of all five-word shingles in order; of the whole sequence if it is shorter, none if it is empty."""

    def at(word: Column, start: Column) -> Column:
        return F.xxhash64(word, *[F.get(tokens, start + k) for k in range(1, WORDS)])

    count = F.greatest(F.size(tokens) - (WORDS - 1), F.lit(1))
    return F.slice(F.transform(tokens, at), F.lit(1), count)


def _fingerprints(members: DataFrame, key: list[str]) -> DataFrame:
    """64-bit fingerprint of each key from (key, h, weight) rows."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{b}") for b in range(BITS)]
    bit = lambda b: F.when(F.col(f"s{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    value = bit(0)
    for b in range(1, BITS):
        value = value.bitwiseOR(bit(b))
    return members.groupBy(*key).agg(*sums).select(*key, value.alias("fingerprint"))


def _blocks(fingerprint: Column) -> Column:
    """(number, value) of the RADIUS + 1 blocks of a fingerprint."""
    n = RADIUS + 1
    edges = [BITS * k // n for k in range(n + 1)]
    blocks = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return F.explode(F.array(*blocks))


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc, row, item_id, size, begin, distance, similarity) of all windows like an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    # Each text of an item_id is an item of its own until the end.
    items = with_words(items).select("item_id", F.xxhash64("item_id", "words").alias("item"), shingles(F.col("words")).alias("shingles"))
    items = items.where(F.size("shingles") > 0).dropDuplicates(["item_id", "item"])
    places = stored(items.select("item_id", "item", F.size("shingles").alias("size"), F.posexplode("shingles").alias("at", "h")), "items")
    n_items = places.select("item").distinct().count()
    rarity = F.log(F.lit(1.0 + n_items) / F.count_distinct("item")) + 1
    weights = stored(places.groupBy("h").agg(_whole(rarity).alias("weight")), "weights")
    unseen = _whole(F.log(F.lit(1.0 + n_items)) + 1)

    rows = docs.select(row_id().alias("doc"), row_key().alias("row"), "text").where("text is not null")
    tokens = with_words(rows)
    scanned = tokens.select("doc", "row", F.posexplode(shingles(F.col("words"))).alias("place", "h"))
    hits = stored(scanned.join(weights.select("h"), "h", "left_semi"), "hits")

    begin = (F.col("place") - F.col("at")).alias("begin")
    windows = hits.join(places, "h").select("doc", "row", "size", begin).distinct()
    per_row = windows.groupBy("doc", "row").agg(F.collect_list(F.struct("size", "begin")).alias("windows"))
    # Equal rows are one row; only those with windows are looked at for that.
    opened = rows.join(per_row, ["doc", "row"]).dropDuplicates(["doc", "row"])
    opened = with_words(opened)
    opened = opened.select("doc", "row", "windows", shingles(F.col("words")).alias("shingles"))
    opened = opened.select("doc", "row", "shingles", F.explode("windows").alias("w"))
    inside = F.slice("shingles", F.greatest(F.col("w.begin"), F.lit(0)) + 1, F.col("w.size") + F.least(F.col("w.begin"), F.lit(0)))
    members = opened.select("doc", "row", "w.size", "w.begin", F.explode(inside).alias("h"))
    members = members.groupBy("doc", "row", "size", "begin", "h").agg(F.count("*").alias("n"))
    members = members.join(weights, "h", "left").withColumn("weight", F.coalesce("weight", unseen))
    members = stored(members, "windows")
    contents = stored(places.groupBy("item_id", "item", "size", "h").agg(F.count("*").alias("n")).join(weights, "h"), "contents")

    window = ["doc", "row", "size", "begin"]
    prints = _fingerprints(members, window).select(*window, "fingerprint", _blocks(F.col("fingerprint")))
    prints = prints.select(*window, "fingerprint", "col.*")
    known = _fingerprints(contents, ["item", "size"]).select("item", "size", F.col("fingerprint").alias("other"), _blocks(F.col("fingerprint")))
    known = known.select("item", "size", "other", "col.*")
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other")))
    near = prints.join(known, ["size", "block", "value"]).select(*window, "item", distance.alias("distance"))
    near = stored(near.where(F.col("distance") <= RADIUS).distinct(), "near")

    mine, theirs = F.col("n"), F.col("m")
    other = contents.select("item", "h", F.col("n").alias("m"))
    shared = near.join(members, window).join(other, ["item", "h"])
    shared = shared.groupBy(*window, "item", "distance").agg(F.sum(F.least(mine, theirs) * F.col("weight")).alias("both"))
    of_window = members.groupBy(*window).agg(F.sum(F.col("n") * F.col("weight")).alias("window_weight"))
    of_item = contents.groupBy("item_id", "item").agg(F.sum(F.col("n") * F.col("weight")).alias("item_weight"))
    joined = shared.join(of_window, window).join(of_item, "item")
    joined = joined.withColumn("either", F.col("window_weight") + F.col("item_weight") - F.col("both"))
    leaks = joined.where(F.col("both") >= F.col("either") * SIMILARITY)
    return leaks.select(*window, "item_id", "distance", (F.col("both") / F.col("either")).alias("similarity"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity) of benchmark passages in ``docs``.

    One row per document and item, of the window most like it (the first of
    equals), if their weighted similarity is at least 0.75. Null and empty texts
    and items match nothing. Items of fewer than five words are one shingle and
    are found only as a whole document of the same words. Repeated ids count as
    one document or item each for the result, and so do all rows without an id;
    every text of them is searched and looked for by itself. Items without an
    id are not looked for.
    """
    leaks = _leaks(docs, benchmark)
    best = F.max(F.struct("similarity", (-F.col("begin")).alias("b"), (-F.col("distance")).alias("d"), "size")).alias("best")
    found = leaks.groupBy(id_of().alias("doc_id"), "item_id").agg(best)
    return found.select(
        "doc_id",
        "item_id",
        (-F.col("best.b")).cast("long").alias("start_word"),
        (F.col("best.size") + WORDS - 1).cast("long").alias("n_words"),
        (-F.col("best.d")).cast("long").alias("distance"),
        F.col("best.similarity").alias("similarity"),
    )


def _whole(weight: Column) -> Column:
    """A weight as a whole number, so that sums do not depend on their order."""
    return F.round(weight * 1000).cast("long")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns.

    Rows are judged one by one, so of a repeated doc_id, or of the rows without
    one, those with a passage go and the others stay.
    """
    leaks = _leaks(docs, benchmark).select(F.col("doc").alias("__doc"), F.col("row").alias("__row")).distinct()
    keyed = docs.withColumn("__doc", row_id()).withColumn("__row", row_key())
    return keyed.join(leaks, ["__doc", "__row"], "left_anti").select(docs.columns)
