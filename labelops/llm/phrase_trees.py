"""Phrase collocation mining over vertically partitioned suffix trees.

Every word position starts a suffix of up to three words within its piece. The
suffixes are dealt out by prefix: a word that starts no more suffixes than the
budget is a prefix of its own, a more frequent one is extended by the next
word, and a pair above the budget once more. Hashing deals the prefixes to
groups of about the budget; each group's depth-truncated suffix tree is built
on its own, and the count of a node is the total of its leaves. A task holds
one group at a time.

A phrase is as frequent as its rarest word at most, so a suffix ends before the
first word that is too rare. Rare words are told by a bit filter of bounded
size; what it lets through by mistake is counted and costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelops.session import stored

LEAST = 10
TOP = 2000
#: Suffixes that one prefix, and on average one group, may have: this many, or this share of all if that is less.
BUDGET = 1 << 20
SHARES = 1 << 10
#: Bits of a filter (2 MB).
FILTER_BITS = 1 << 24
#: Bytes of text a task counts together; a longer text is counted by itself.
BLOCK = 1 << 22
#: Rows handed from Python to the executor at a time.
PASSED = 1 << 15
#: A longer phrase with this percentage of a phrase's count explains it.
CONTAINED = 50
UNKNOWN = "und"

# What ends a piece, what separates words, A-Z in lower case.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

_BITMAP = 32768  # bits of one bitmap_construct_agg


class Filter:
    """Set of prefixes by the bits of their checksums; may hold more than was put in, never less."""

    def __init__(self, bits: bytes):
        self.bits = bits
        self.size = len(bits) * 8

    def __contains__(self, prefix: bytes) -> bool:
        at = crc32(prefix) % self.size
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def _filter_of(prefixes: DataFrame, size: int) -> Filter:
    """The filter of a column ``prefix``; at most ``size`` bits reach the driver."""
    at = F.crc32("prefix") % size + 1
    maps = prefixes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("number"))
    bits = bytearray(size // 8)
    for row in maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
        start = (row["number"] - 1) * _BITMAP // 8
        bits[start : start + _BITMAP // 8] = row["bits"]
    return Filter(bytes(bits))


def _key(lang: bytes, *words: bytes) -> bytes:
    return b" ".join((lang, *words))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).cast("binary").alias("lang"), text.cast("binary").alias("text"))


class _Block:
    """The words of some texts, numbered by language and word.

    ``ids`` has one number for each word in order, ``piece`` that of its piece.
    """

    def __init__(self, langs: list[bytes], texts: list[bytes]):
        joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        breaks = joined == 10
        inside = ~(breaks | (joined == 32))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        data = pa.py_buffer(joined[inside].tobytes())
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), data])
        encoded = words.dictionary_encode()
        text_of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        lang_of, self.langs = pd.factorize(np.array(langs, dtype=object))
        size = max(1, len(encoded.dictionary))
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, keys = pd.factorize(lang_of[text_of] * size + codes if len(starts) else codes)
        self.piece = np.cumsum(breaks)[starts] if len(starts) else starts
        self.lang_of_id = keys // size
        self.words = encoded.dictionary.take(pa.array(keys % size))

    def lang_column(self, ids: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.binary()).take(pa.array(self.lang_of_id[ids]))

    def pair_names(self, first: np.ndarray, second: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(self.words.take(pa.array(first)), self.words.take(pa.array(second)), b" ")

    def keys(self) -> list[bytes]:
        """Language and word of each number."""
        return [_key(self.langs[lang], word) for lang, word in zip(self.lang_of_id.tolist(), self.words.to_pylist())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if size + len(text) > BLOCK and texts:
                yield _Block(langs, texts)
                langs, texts, size = [], [], 0
            langs.append(lang)
            texts.append(text.translate(_PLAIN))
            size += len(text) + 1
    if texts:
        yield _Block(langs, texts)


def _passed_on(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that the executor never holds a block's rows at once."""
    for start in range(0, batch.num_rows, PASSED):
        yield batch.slice(start, PASSED)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        counts = np.bincount(block.ids, minlength=len(block.words))
        langs = block.lang_column(np.arange(len(counts)))
        yield from _passed_on(pa.RecordBatch.from_arrays([langs, block.words, pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"]))


def _heavy_pairs(heavy: Filter):
    """Counts of the pairs of words above the budget; no other pair can be above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys = block.keys()
            size = max(1, len(keys))
            often = np.fromiter((k in heavy for k in keys), bool, len(keys))[block.ids]
            first = np.flatnonzero(often[:-1] & often[1:] & (block.piece[:-1] == block.piece[1:]))
            pair_of, pairs = pd.factorize(block.ids[first] * np.int64(size) + block.ids[first + 1])
            counts = np.bincount(pair_of, minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.lang_column(pairs // size), block.pair_names(pairs // size, pairs % size), pa.array(counts)], ["lang", "phrase", "f"]
            )

    return run


_SUFFIXES = "grp int, part boolean, lang binary, pair binary, third binary, c bigint"


def _suffixes(frequent: Filter, heavy: Filter, heavy_pairs: Filter, groups: int):
    """Suffixes of two or three frequent words with their counts in a block and their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from _passed_on(counted(block))

    def counted(block: _Block) -> pa.RecordBatch:
        keys = block.keys()
        size = len(keys)
        kept = np.fromiter((k in frequent for k in keys), bool, size)
        ids, piece = block.ids, block.piece
        good = np.concatenate((kept[ids], [False, False]))
        after = np.concatenate((piece, [-1, -1]))
        first = np.flatnonzero(good[:-2] & good[1:-1] & (after[:-2] == after[1:-1]))
        with_third = good[first + 2] & (after[first] == after[first + 2])
        following = np.concatenate((ids, [0, 0]))
        pair_of, pairs = pd.factorize(ids[first] * np.int64(size) + following[first + 1])
        # 0 stands for no third word.
        third = np.where(with_third, following[first + 2] + 1, 0)
        suffix_of, suffixes = pd.factorize(pair_of * np.int64(size + 1) + third)
        counts = np.bincount(suffix_of, minlength=len(suffixes)).astype(np.int64)
        # Neighbours with the same first words compress better.
        order = np.argsort(pairs[suffixes // (size + 1)], kind="stable")
        suffixes, counts = suffixes[order], counts[order]
        own, thirds = suffixes // (size + 1), suffixes % (size + 1)
        heads, seconds = pairs // max(size, 1), pairs % max(size, 1)
        pair_names = block.pair_names(heads, seconds)
        third_names = pa.concat_arrays([pa.array([b""], pa.binary()), block.words]).take(pa.array(thirds))

        extended = np.fromiter((kept[i] and k in heavy for i, k in enumerate(keys)), bool, size)
        by_word = np.fromiter((crc32(k) % groups for k in keys), np.int32, size)
        by_pair = by_word[heads]
        split_pair = np.zeros(len(pairs), bool)
        long = np.flatnonzero(extended[heads])
        names = pair_names.take(pa.array(long)).to_pylist()
        for p, lang, name, second in zip(long.tolist(), block.lang_of_id[heads[long]].tolist(), names, extended[seconds[long]].tolist()):
            prefix = _key(block.langs[lang], name)
            by_pair[p] = crc32(prefix) % groups
            split_pair[p] = second and prefix in heavy_pairs
        group, split = by_pair[own], split_pair[own]
        for n in np.flatnonzero(split).tolist():
            prefix = keys[heads[own[n]]] + b" " + pair_names[own[n]].as_py() + b" " + third_names[n].as_py()
            group[n] = crc32(prefix) % groups
        columns = [pa.array(group), pa.array(split), block.lang_column(heads[own]), pair_names.take(pa.array(own)), third_names, pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["grp", "part", "lang", "pair", "third", "c"])

    return run


_NODES = "lang binary, phrase binary, words int, f bigint"


def _trees(least: int):
    """Trees of whole groups: pairs and triples that are frequent, and parts of split pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([not held or held[-1].column(0)[-1].as_py() != group[0]], group[1:] != group[:-1])))
            cuts = [0, *starts.tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start in starts and held and start != end:
                    yield from nodes(held)
                    held = []
                if start != end:
                    held.append(batch.slice(start, end - start))
        if held:
            yield from nodes(held)

    def nodes(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = total(pa.Table.from_batches(rows), ["part", "lang", "pair", "third"])
        pairs = total(leaves, ["part", "lang", "pair"])
        pairs = pairs.filter(pc.or_(pairs["part"], pc.greater_equal(pairs["c"], least)))
        yield from found(pairs["lang"], pairs["pair"], 2, pairs["c"])
        triples = leaves.filter(pc.and_(pc.greater_equal(leaves["c"], least), pc.not_equal(leaves["third"], b"")))
        yield from found(triples["lang"], pc.binary_join_element_wise(triples["pair"], triples["third"], b" "), 3, triples["c"])

    def total(table: pa.Table, names: list[str]) -> pa.Table:
        return table.group_by(names, use_threads=False).aggregate([("c", "sum")]).rename_columns([*names, "c"])

    def found(lang, phrase, words: int, f) -> Iterator[pa.RecordBatch]:
        number = pa.array(np.full(len(f), words, np.int32))
        yield from pa.Table.from_arrays([lang, phrase, number, f], ["lang", "phrase", "words", "f"]).to_batches()

    return run


def _as_text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f): occurrences of every word."""
    counted = _texts(docs).mapInArrow(_word_counts, "lang binary, phrase binary, f bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(
    docs: DataFrame, words: DataFrame, least: int = LEAST, budget: int = BUDGET, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, phrase, words, f): phrases of two and three words with at least ``least`` occurrences.

    ``words`` is the result of ``word_counts``, stored.
    """
    texts = _texts(docs)
    spark = docs.sparkSession
    key = F.concat_ws(" ", F.col("lang").cast("string"), F.col("phrase").cast("string")).cast("binary")
    frequent = words.where(F.col("f") >= least)
    total = frequent.agg(F.sum("f")).first()[0] or 0
    budget = max(1, min(budget, int(total) // SHARES))
    kept = _filter_of(frequent.select(key.alias("prefix")), filter_bits)
    heavy = _filter_of(words.where(F.col("f") > budget).select(key.alias("prefix")), filter_bits)
    heavy_pairs = Filter(bytes(filter_bits // 8))
    if any(heavy.bits):
        pairs = texts.mapInArrow(_heavy_pairs(heavy), "lang binary, phrase binary, f bigint")
        pairs = pairs.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") > budget)
        heavy_pairs = _filter_of(pairs.select(key.alias("prefix")), filter_bits)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Several groups a partition even out their sizes.
    groups = max(16 * partitions, 2 * int(total) // budget)
    suffixes = texts.mapInArrow(_suffixes(kept, heavy, heavy_pairs, groups), _SUFFIXES)
    trees = suffixes.repartition(partitions, "grp").sortWithinPartitions("grp")
    nodes = trees.mapInArrow(_trees(least), _NODES)
    return nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mine_phrases(
    docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    ``docs`` has lang and text; other columns are not read. A null lang is
    ``und`` and shares its counts, a null text is empty, repeated rows count
    each. Texts are counted whole, whatever their length. A language without
    frequent phrases gives no rows, an empty table an empty one. Equal scores
    and counts are ordered by the bytes of the phrase.
    """
    words = stored(word_counts(docs), "words")
    phrases = stored(phrase_counts(docs, words, least, budget, filter_bits).select(_as_text("lang"), _as_text("phrase"), "words", "f"), "phrases")
    words = words.select(_as_text("lang"), _as_text("phrase"), "f")
    size = words.groupBy("lang").agg(F.sum("f").alias("n"))

    # Every cut of a candidate, with the counts of its two sides.
    split = F.split("phrase", " ", -1)
    sides = lambda k: F.struct(
        F.lit(k).alias("k"), F.array_join(F.slice(split, 1, k), " ").alias("left"), F.array_join(F.slice(split, k + 1, 2), " ").alias("right")
    )
    cuts = F.when(F.col("words") == 2, F.array(sides(1))).otherwise(F.array(sides(1), sides(2)))
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.inline(cuts))
    counts = words.where(F.col("f") >= least).unionByName(phrases.where("words = 2").drop("words"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    square = (F.lit(1000000).cast("decimal(7,0)") * (whole("a") * whole("a")).cast("decimal(31,0)")).cast("decimal(38,0)")
    rated = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    rated = rated.withColumns({"top": square, "under": (whole("l") * whole("r")).cast("decimal(38,0)")})
    rated = rated.select("lang", "phrase", "a", F.struct(F.expr("top div under").alias("score"), "k", "l", "r").alias("cut"))
    lowest = rated.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    # Pairs explained by a triple that holds them.
    triple = phrases.where("words = 3").select(
        "lang", F.explode(F.array(F.array_join(F.slice(split, 1, 2), " "), F.array_join(F.slice(split, 2, 2), " "))).alias("phrase"), "f"
    )
    longer = triple.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED * F.col("a"))
    )
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
