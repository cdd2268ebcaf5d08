"""N-gram Jaccard self-join of documents over token-combination prefixes.

Two documents link when their sets of five-word shingles have a Jaccard
similarity of at least 0.75. All links between different sets are found:

1. Equal sets are one entity from here on; its members are linked trivially.
2. Shingles are ordered rare first. With an overlap of at least t = 0.75 * size,
   two linked sets share k shingles within their first size - t + k (the
   extended prefix). If the first shared one is rare, it lies in the plain
   prefix (k = 1) of both, which is indexed by single shingles. Otherwise all
   shared ones are frequent, and two of them lie in the prefix extended to
   k = 2, which is indexed by pairs of frequent shingles. Pairs are formed for
   sets of up to PAIR_SIZE shingles only; larger sets index their frequent
   shingles singly. Sets between PAIR_SIZE and PAIR_SIZE / 0.75 do both, so no
   link across the limit is lost.
   Linked sets even share k shingles within their prefixes extended by k. Each
   set extends by 1 + size // SLACK, so one that has fewer shingles there which
   are frequent or held by another set than its least partner's extension has
   no links, and its rare shingles are left out of what follows.
3. Entities sharing an index key are candidates if their sizes are near enough:
   sizes fall into bands of ratio 4/3, and a key is looked at for every two
   neighbouring bands by itself. They are not paired up: each
   is listed under the smallest entity of the key, its centre. All entities
   that share a key share its centre, so every candidate pair meets in the
   group of a centre.
4. Bits at the hashes of the shingles tell how many of them a set must have for
   itself, which bounds each intersection from above; only entities that pass
   the bound with another one of their group go on, so few texts are moved. The
   bits grow with the set, so that the bound tells long texts apart as well.
   What may link in a group is split into its components, and a component that
   several groups have is verified once: two linked texts meet under each centre
   that shares a key with both by chance, and of these there are ever more.
   A group is verified exactly by set intersection, in tasks of at most
   BLOCK entities (or two blocks), which give back a spanning forest of the
   links found. Groups above BLOCK are first verified block by block, each
   block with the centre; only the entities that stay apart from the centre's
   component are then compared with the other blocks.
5. Connected components of those forests are those of all links.

Frequent shingles are those held by at least FREQUENT of the documents of some
input partition. They steer the order only; any set of them gives the same
result. Shingles stand as 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.llm.components import components
from labelops.llm.rows import id_of, row_id, row_key
from labelops.llm.shingles import mix, shingle_lists
from labelops.session import stored

PERCENT = 75
PAIR_SIZE = 48
SLACK = 20
BLOCK = 512
#: Bits of a set are a power of two of at least twice its size, or its size above this one.
LONG = 2048
#: Least and largest power, the latter for 16 KB.
LEAST_BITS, MOST_BITS = 6, 17
FREQUENT = 0.0005
FREQUENT_LEAST = 4
#: Size of the filter of rows that are moved, 4 MB.
KEY_BITS = 1 << 25

_SINGLE, _PAIR = np.uint64(0x51A3C2B1), np.uint64(0x9B97F4A7)


def min_overlap(size: int, percent: int = PERCENT) -> int:
    """Least number of shared shingles of a linked set of this size."""
    return -(-percent * size // 100)


def _set_keys(values: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set."""
    a = mix(values + np.uint64(0x1F83D9AB)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(values ^ np.uint64(0x5BE0CD19137E2179)))
    return int(mix(np.array([a]))[0].view(np.int64)), int((a ^ b).view(np.int64))


def level(size: int) -> int:
    """Of how many bits a set has, the power; sizes of linked sets have the same or neighbouring ones."""
    return max(LEAST_BITS, min(MOST_BITS, (size - 1).bit_length() + (size <= LONG)))


def set_bits(values: np.ndarray) -> bytes:
    """Bits at the hashes of the shingles of a set, none for an empty set. Halves laid over each other are those of half the length."""
    if not len(values):
        return b""
    bits = np.zeros(1 << level(len(values)), bool)
    bits[(mix(values ^ np.uint64(0xB5026F5AA96619E9)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set size and keys (doc not null); per partition its frequent shingles (doc null)."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bits", pa.binary())])
    seen: set[int] = set()
    pending: list[np.ndarray] = []
    size = documents = 0
    held, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def fold(held, counts):
        new, n = np.unique(np.concatenate(pending), return_counts=True)
        keep = n >= 2
        merged = np.concatenate((held, new[keep]))
        held, where = np.unique(merged, return_inverse=True)
        return held, np.bincount(where, np.concatenate((counts, n[keep])), len(held)).astype(np.int64)

    for batch in batches:
        rows, marked = [], []
        for values in shingle_lists(batch.column(1).to_pylist()):
            values = np.unique(values)
            marked.append(set_bits(values))
            keys = _set_keys(values) if len(values) else (0, 0)
            rows.append((len(values), *keys))
            documents += 1
            if len(values) and keys[0] not in seen:
                seen.add(keys[0])
                pending.append(values)
                size += len(values)
                if size >= 1 << 21:
                    held, counts = fold(held, counts)
                    pending, size = [], 0
        columns = np.array(rows, dtype=np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in columns.T), pa.array(marked, pa.binary())], schema=schema)
    if pending:
        held, counts = fold(held, counts)
    often = counts >= max(FREQUENT_LEAST, FREQUENT * documents)
    values = held[often].view(np.int64)
    nulls = pa.nulls(len(values), pa.int64())
    columns = [nulls, nulls, pa.array(counts[often]), pa.array(values), nulls, pa.nulls(len(values), pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, schema=schema)


def signatures(
    values: np.ndarray, frequent: np.ndarray, rank: np.ndarray
) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Index keys of one set of shingle hashes (sorted, distinct).

    They are those of rare shingles in the prefix extended by 1 + size // SLACK,
    the number of them in the plain prefix (they come first), how many of them
    another set must hold too if this one has links, and the keys of common
    shingles.

    ``frequent`` holds the frequent shingles, sorted, and ``rank`` their places
    in the order among themselves, the rarest first.
    """
    n = len(values)
    t = min_overlap(n)
    at = np.searchsorted(frequent, values)
    at[at == len(frequent)] = 0
    often = frequent[at] == values if len(frequent) else np.zeros(n, bool)
    rare = values[~often]
    plain, extended = n - t + 1, n - t + 2
    keys = [np.empty(0, np.uint64)]
    if len(rare) < min(n, extended):
        common = values[often][np.argsort(rank[at[often]])]
        if n > PAIR_SIZE:
            keys.append(mix(common[: max(0, plain - len(rare))] ^ _SINGLE))
        if n * PERCENT <= PAIR_SIZE * 100:
            head = common[: extended - len(rare)]
            i, j = np.triu_indices(len(head), 1)
            keys.append(mix(head[i] * np.uint64(3) + mix(head[j] ^ _PAIR)))
    # No partner is smaller than t, so none extends its prefix by less than this.
    shared = 1 + t // SLACK
    reach = plain + n // SLACK
    counted = rare[:reach]
    need = max(0, shared - (min(reach, n) - len(counted)))
    return mix(counted ^ _SINGLE), min(plain, len(counted)), need, np.concatenate(keys)


def _limits() -> list[int]:
    """Least sizes of bands: sizes of linked sets are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // PERCENT + 1)
    return out


_LIMITS = _limits()


def band(size: int) -> int:
    return bisect_right(_LIMITS, size)


def _index(frequent: np.ndarray, rank: np.ndarray, common: bool):
    """Index keys (sig, entity, info), either those of rare shingles or those of common ones.

    ``info`` packs, from the lowest bit: whether the key is in the plain prefix
    (1 bit), the band of the set (8 bits), the number of keys to be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, entities, infos = [], [], []
            for values in shingle_lists(batch.column(0).to_pylist()):
                values = np.unique(values)
                entity = _set_keys(values)[0] if len(values) else 0
                if len(values) < 2 or entity in seen:
                    continue
                seen.add(entity)
                rare, plain, need, often = signatures(values, frequent, rank)
                own = often if common else rare
                info = np.full(len(own), need << 9 | band(len(values)) << 1 | 1, np.int32)
                if not common:
                    info[plain:] -= 1
                keys.append(own)
                entities.append(np.full(len(own), entity, np.int64))
                infos.append(info)
            if keys:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(entities), np.concatenate(infos)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "entity", "info"])

    return run


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the rows (entity, text) whose text has the entity's set, and of equal ones in a row the first."""
    last = None
    for batch in batches:
        sets = shingle_lists(batch.column(1).to_pylist())
        keys = [_set_keys(np.unique(s))[0] if len(s) else 0 for s in sets]
        own = []
        for key, entity in zip(keys, batch.column(0).to_pylist()):
            own.append(key == entity != last)
            last = entity if own[-1] else last
        yield batch.filter(pa.array(own, pa.bool_()))


def forest(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Links that span the components of all linked pairs of one block, or between two blocks.

    Sets are sorted distinct hashes. Pairs of positions are returned; with two
    blocks, positions of the right one follow those of the left one.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    uses = np.bincount(column, minlength=len(tokens))
    shared = uses[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    split = len(left) if right is not None else len(sets)
    first, second = (slice(0, split), slice(split, None)) if right is not None else (slice(None), slice(None))
    common = np.zeros((len(sizes[first]), len(sizes[second])), np.float32)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(column, column[begin] + 2048))
        used, local = np.unique(column[begin:end], return_inverse=True)
        block = np.zeros((len(sets), len(used)), np.float32)
        block[row[begin:end], local] = 1
        common += block[first] @ block[second].T
        begin = end
    union = sizes[first][:, None] + sizes[second][None, :] - common
    linked = 100 * common.astype(np.float64) >= PERCENT * union
    label = np.arange(len(sets))
    links = []
    for i in range(linked.shape[0]):
        others = np.flatnonzero(linked[i]) + (split if right is not None else 0)
        for j in others[np.unique(label[others], return_index=True)[1]].tolist():
            if label[i] != label[j]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, entity, text), sorted by unit and side, to links (a, b)."""

    def links(rows):
        sets = [np.unique(s) for s in shingle_lists([r[3] for r in rows])]
        names = [r[2] for r in rows]
        split = sum(r[1] == 0 for r in rows)
        if 0 < split < len(rows):
            found = forest(sets[:split], sets[split:])
        else:
            found = forest(sets, None)
        return [(names[i], names[j]) for i, j in found]

    def out(found):
        a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for rows in _by_unit(batches, 4):
        if len(rows) > 1 and (found := links(rows)):
            yield out(found)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, side, entity, n, bits), sorted by unit and side, to those (unit, side, entity) that may link in their unit.

    The units given back are the components of what may link, named by their rows.
    """

    def passing(rows: list[tuple]) -> list[tuple]:
        sides = np.array([r[1] for r in rows])
        names = np.array([r[2] for r in rows], np.int64)
        sizes = np.array([r[3] for r in rows])
        widths = np.array([len(r[4]) for r in rows])
        two = len(set(sides.tolist())) > 1
        part = np.arange(len(rows))
        for width in np.unique(widths).tolist():
            # Sets with twice as many bits are folded; those with others are too large or too small.
            own, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
            at = np.concatenate((own, wider))
            words = np.frombuffer(b"".join(rows[i][4] for i in at.tolist()), np.uint64)
            split = len(own) * width // 8
            folded = np.bitwise_or.reduce(words[split:].reshape(len(wider), 2, width // 8), axis=1)
            words = np.concatenate((words[:split].reshape(len(own), width // 8), folded))
            for i, one in enumerate(own.tolist()):
                rest = at[i + 1 :]
                fit = 100 * np.minimum(sizes[one], sizes[rest]) >= PERCENT * np.maximum(sizes[one], sizes[rest])
                fit &= names[rest] != names[one]
                if two:
                    fit &= sides[rest] != sides[one]
                rest, others = rest[fit], words[i + 1 :][fit]
                most = sizes[one] - np.bitwise_count(words[i] & ~others).sum(axis=1, dtype=np.int64)
                most = np.minimum(most, sizes[rest] - np.bitwise_count(others & ~words[i]).sum(axis=1, dtype=np.int64))
                near = rest[100 * most >= PERCENT * (sizes[one] + sizes[rest] - most)]
                if len(near):
                    part[np.isin(part, part[near])] = part[one]
        _, part, held = np.unique(part, return_inverse=True, return_counts=True)
        unit = np.zeros(len(held), np.uint64)
        np.add.at(unit, part, mix(names.view(np.uint64) * np.uint64(3) + sides.astype(np.uint64)))
        unit = mix(unit).view(np.int64)
        return [(int(unit[k]), r[1], r[2]) for k, r in zip(part.tolist(), rows) if held[k] > 1]

    schema = pa.schema([("unit", pa.int64()), ("side", pa.int32()), ("entity", pa.int64())])
    for rows in _by_unit(batches, 5):
        if len(rows) > 1 and (kept := passing(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def _by_unit(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """The rows of each unit; rows come sorted by their first column."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns))):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _possible_units(units: DataFrame, marked: DataFrame) -> DataFrame:
    """Units of the entities of units (unit, side, entity) that may link there by their bits (entity, n, bits)."""
    rows = units.join(marked, "entity").select("unit", "side", "entity", "n", "bits")
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "side", "entity")
    return stored(dealt.mapInArrow(_possible, "unit long, side int, entity long").distinct(), "possible")


def _may_hold(rows: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("doc", "row")) -> DataFrame:
    """The rows whose columns ``by`` may be among ``keys``: all that are, and few others.

    The keys are bits at their hashes, of which there are KEY_BITS at most,
    whatever the number of keys; more keys only let more other rows pass. So
    they are never too many to broadcast, which keeps ``rows`` where they are.
    """
    bit = F.xxhash64(*by).bitwiseAND(F.lit(KEY_BITS - 1))
    page, place = F.shiftright(bit, 15).alias("page"), bit.bitwiseAND(F.lit((1 << 15) - 1))
    pages = stored(keys.groupBy(page).agg(F.bitmap_construct_agg(place).alias("held")), "key_bits")
    byte = F.conv(F.hex(F.substring("held", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), place.bitwiseAND(F.lit(7))).cast("int")) != 0
    return rows.withColumn("page", page).join(F.broadcast(pages), "page").where(held).select(rows.columns)


def _marked(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """(entity, n, bits) of all members of groups."""
    members = stars.select("entity").union(stars.select("centre"))
    marked = _may_hold(sets.where("n > 0").select("entity", "n", "bits"), members, ("entity",))
    return stored(marked.groupBy("entity").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "marked")


def _texts(entities: DataFrame, owner: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, text) of the given entities. Their documents are shuffled for it, so none is asked for twice."""
    wanted = stored(owner.join(entities.distinct(), "entity", "left_semi").select("entity", "doc", "row"), "wanted")
    # The wanted documents grow with the corpus, so they are never broadcast.
    texts = wanted.hint("merge").join(_may_hold(docs, wanted), ["doc", "row"]).select("entity", "text")
    return stored(texts.mapInArrow(_own_texts, "entity long, text string"), "texts")


def _links(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of units."""
    rows = units.join(texts, "entity").select("unit", "side", "entity", "text")
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "side", "entity")
    return stored(dealt.mapInArrow(_verify, "a long, b long"), "links")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    A null or empty text, and one without words, has no shingles and is linked
    with nothing, so its component is its own id. Equal texts are linked. A
    repeated doc_id gives one row for each of its rows; its component is that
    of its own text. Rows without a doc_id link like all others and have the
    component of the ids they reach, null if none. Other columns are ignored.
    Empty tables give no rows.
    """
    spark = docs.sparkSession
    # Texts are found again by keys that neither null nor repeated ids blur.
    docs = docs.select(row_id().alias("doc"), "text", row_key().alias("row"))
    scanned = stored(docs.mapInArrow(_scan, "doc long, row long, n long, k1 long, k2 long, bits binary"), "sets")
    sets = scanned.where("k2 is not null").select("doc", "row", "n", F.col("k1").alias("entity"), "bits")

    # At most 1 / FREQUENT * (mean size of a set) shingles pass this filter.
    total = sets.count()
    often = scanned.where("k2 is null").groupBy("k1").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") >= max(FREQUENT_LEAST, FREQUENT * total)).toArrow()
    frequent = often.column("k1").to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    frequent, held = frequent[order], often.column("n").to_numpy()[order]
    rank = np.empty(len(held), np.int64)
    rank[np.lexsort((frequent, held))] = np.arange(len(held))

    stars = _grouped(_listed(docs.select("text"), frequent, rank))

    owner = sets.where("n > 0").groupBy("entity").agg(F.min(F.struct("doc", "row")).alias("key"), F.min(id_of()).alias("id"))
    owner = stored(owner.select("entity", "key.*", "id"), "owners")
    spot = F.when(F.col("blocks").isNull(), 0).otherwise(_spot("blocks"))
    members = stars.select("centre", spot.alias("spot"), "entity")
    heads = members.select("centre", "spot").distinct().select("centre", "spot", F.col("centre").alias("entity"))
    units = members.union(heads).select(F.xxhash64("centre", "spot").alias("unit"), F.lit(0).alias("side"), "entity")
    marked = _marked(stars, sets)
    units = _possible_units(units, marked)
    texts = _texts(units.select("entity"), owner, docs)
    links = _links(units, texts)
    found = components(links)

    large = stars.where("blocks is not null")
    if not large.isEmpty():
        units = _possible_units(_apart(large, found), marked)
        more = stored(units.select("entity").distinct().join(texts.select("entity"), "entity", "left_anti"), "more")
        if not more.isEmpty():
            texts = texts.union(_texts(more, owner, docs))
        links = links.union(_links(units, texts))
        found = components(links)

    roots = found.select(F.col("node").alias("entity"), "root")
    owner = owner.join(roots, "entity", "left").select("entity", "id", F.coalesce("root", "entity").alias("root"))
    least = owner.groupBy("root").agg(F.min("id").alias("component"))
    components_of = owner.join(least, "root").select("entity", "component")
    return sets.join(components_of, "entity", "left").select(
        id_of().alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(id_of()).alias("component_id"),
    )


def _grouped(listed: DataFrame) -> DataFrame:
    """(centre, entity, blocks): the groups to verify, ``blocks`` being null for those of one block."""
    sizes = listed.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return stored(listed.join(sizes.where("blocks > 1"), "centre", "left"), "stars")


def _spot(blocks: str, seed: int = 0):
    return F.pmod(F.xxhash64("entity", F.lit(seed)), F.col(blocks)).cast("int")


def _listed(texts: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(centre, entity) without repeats, for every entity that shares a key with a smaller one.

    Keys of rare shingles are held by few entities each and are looked at
    together; those of frequent ones are reduced to their smallest entity
    before it is joined back, so that no task sees all rows of such a key.
    """
    schema = "sig long, entity long, info int"
    own_band = F.expr("shiftright(info, 1) & 255")
    bands = F.explode(F.array(own_band, own_band + 1)).alias("band")
    rare = texts.mapInArrow(_index(frequent, rank, False), schema)
    # Copies of a set in several partitions give its keys repeatedly; they share nothing with each other.
    near = _with_enough(_held_twice(rare, "sig").distinct()).where("info & 1 = 1")
    # Dealt by the key alone, before each row is doubled for its two bands.
    near = near.select("sig", "entity", "info").repartition("sig").select("sig", "entity", bands)
    centre = F.min("entity").over(Window.partitionBy("sig", "band")).alias("centre")
    listed = near.select(centre, "entity").where("centre <> entity")
    if len(frequent):
        common = stored(texts.mapInArrow(_index(frequent, rank, True), schema), "common").select("sig", "entity", bands)
        least = common.groupBy("sig", "band").agg(F.min("entity").alias("centre"), F.max("entity").alias("last"))
        least = least.where("centre <> last").select("sig", "band", "centre")
        listed = listed.union(common.join(least, ["sig", "band"]).where("centre <> entity").select("centre", "entity"))
    return stored(listed.distinct(), "candidates")


def _held_twice(keys: DataFrame, by: str) -> DataFrame:
    """The rows whose key is held by more than one entity."""
    of_key = Window.partitionBy(by)
    told = keys.select("*", F.min("entity").over(of_key).alias("least"), F.max("entity").over(of_key).alias("last"))
    return told.where("least <> last").drop("least", "last")


def _with_enough(keys: DataFrame) -> DataFrame:
    """The rows of entities that share as many keys as a link takes; an entity has no more rows than shingles."""
    counted = keys.withColumn("n", F.count("*").over(Window.partitionBy("entity")))
    return counted.where(F.col("n") >= F.shiftright("info", 9)).drop("n")


def _apart(large: DataFrame, found: DataFrame) -> DataFrame:
    """Units that compare what is not yet in its centre's component with all members of the group."""
    roots = found.select(F.col("node").alias("entity"), "root")
    heads = found.select(F.col("node").alias("centre"), F.col("root").alias("head"))
    members = large.join(roots, "entity", "left").join(heads, "centre", "left")
    lone = members.where("coalesce(root, entity) <> coalesce(head, centre)").select("centre", "entity", "blocks")
    counts = lone.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lone_blocks"))
    lone = lone.join(counts, "centre").withColumn("i", _spot("lone_blocks", 1))
    lone = lone.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = large.join(counts, "centre").withColumn("j", _spot("blocks"))
    members = members.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lone_blocks") - 1)))
    unit = F.xxhash64("centre", "i", "j").alias("unit")
    return lone.select(unit, F.lit(0).alias("side"), "entity").union(members.select(unit, F.lit(1).alias("side"), "entity"))
