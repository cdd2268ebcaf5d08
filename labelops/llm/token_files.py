"""Token ids in flat binary files.

A token table is a folder of parts in ascending order of doc_id. Part k has

* ``*.ids``: all token ids as unsigned little-endian integers, of 16 bits if all
  ids of the vocabulary fit, else of 32 bits,
* ``*.offsets``: n_docs + 1 signed 64-bit little-endian token offsets in it,
* ``*.docs``: the doc_id of each document as signed 64-bit integers, 0 for null,

and a Parquet manifest lists per part its file name, its numbers of documents
and tokens, the bytes of an id, and how many of its documents have no doc_id;
these come first. The offset of a part in the whole corpus is a prefix sum
over the manifest, so no part waits for another.

Names hold a random part: a task that runs twice, after the loss of an executor
or speculatively, writes other files, and the manifest lists those of the
attempt that Spark committed.
"""

from __future__ import annotations

import gc
import itertools
import json
import mmap
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelops.arrow import text_slices
from labelops.llm.bpe import CACHE_ENTRIES, Bpe, atoms, byte_symbols
from labelops.session import scratch_path

MANIFEST_SCHEMA = "part int, name string, n_docs long, n_tokens long, width int, n_null long"
MANIFEST = pa.schema(
    [
        ("part", pa.int32()),
        ("name", pa.string()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("width", pa.int32()),
        ("n_null", pa.int64()),
    ]
)
#: Bytes of text that are encoded together.
SLICE_BYTES = 6 << 20


def folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


#: Pieces that the pattern never cuts, of scripts whose letters no version of Unicode tells apart.
_ONE_WORD = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")


class _Library(Bpe):
    """The tokenizers library on the pieces of texts, each distinct piece once.

    Only for byte-level vocabularies without a normaliser, whose words never
    span the places where pieces are cut. Pieces that are a single word go to
    the library's model as they are, all others through its whole encoder.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))

    #: Pieces that are encoded as one text, a special token between them.
    JOINED = 1000

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of each text of a column, as ``encode`` has them; a word is looked up once a column."""
        if not len(texts):
            return []
        if len(self.known) > 2 * CACHE_ENTRIES:
            self.known.clear()
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for mark in self.specials:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        parts = cut.flatten()
        follows = np.ones(len(parts), bool)
        follows[begins] = False
        words = parts.filter(pa.array(follows)).dictionary_encode()
        index = words.indices.to_numpy(zero_copy_only=False)
        names = pc.binary_join_element_wise(" ", words.dictionary, "").to_numpy(zero_copy_only=False).tolist()
        heads = parts.take(pa.array(begins)).to_numpy(zero_copy_only=False).tolist()
        # Texts with white space around a single space can't be cut there, as in ``pieces``.
        spaces = np.array([w == " " or w[1].isspace() or w[-1].isspace() for w in names], bool)
        last = ends - np.arange(1, len(texts) + 1)
        first = np.concatenate(([0], last[:-1]))
        held = np.concatenate(([0], np.cumsum(spaces[index])))
        whole |= held[last] > held[first]
        whole |= (last > first) & np.array([not h or h[-1].isspace() for h in heads], bool)
        collecting = gc.isenabled()
        gc.disable()
        try:
            known = self.known
            self._know_pieces([w for w in names if w not in known and not w[-1].isspace()] + [h for h in heads if h not in known])
            ids = [known.get(w) for w in names]
            index = index.tolist()
            out = [
                None if w else np.frombuffer(known[h] + b"".join([ids[k] for k in index[b:e]]), "<u4")
                for w, h, b, e in zip(whole.tolist(), heads, first.tolist(), last.tolist())
            ]
        finally:
            if collecting:
                gc.enable()
        others = np.flatnonzero(whole)
        for k, found in zip(others.tolist(), self.encode(texts.take(pa.array(others)).to_pylist())):
            out[k] = found
        return out

    def _know_pieces(self, new: list[str]) -> None:
        """Learn pieces by their atoms."""
        known, single = self.known, _ONE_WORD.fullmatch
        words, cut = [], {}
        for piece in new:
            if single(piece):
                words.append(piece)
            else:
                cut[piece] = atoms(piece)
        known.update(zip(words, self._modelled(words)))
        unknown = list({a for own in cut.values() for a in own if a not in known})
        known.update(zip(unknown, self._learn(unknown)))
        for piece, own in cut.items():
            if len(own) > 1:
                known[piece] = b"".join([known[a] for a in own])

    def _learn(self, new: list[str]) -> list[bytes]:
        words = [p for p in new if _ONE_WORD.fullmatch(p)]
        ids = dict(zip(words, self._modelled(words)))
        others = [p for p in new if p not in ids]
        ids.update(zip(others, self._encoded(others)))
        return [ids[p] for p in new]

    def _modelled(self, words: list[str]) -> list[bytes]:
        """Ids of pieces of a single word."""
        tokenize, symbols = self.model.tokenize, self._symbols
        lists = [[t.id for t in tokenize(symbols(w))] for w in words]
        data = np.fromiter(itertools.chain.from_iterable(lists), "<u4").tobytes()
        ends = np.cumsum([4 * len(own) for own in lists], dtype=np.int64).tolist()
        return [data[b:e] for b, e in zip([0, *ends], ends)]

    def _symbols(self, word: str) -> str:
        """The bytes of a word as the characters of the vocabulary."""
        if word.isascii():
            return self.symbols[32] + word[1:] if word[0] == " " else word
        return word.encode().decode("latin-1").translate(self.symbols)

    def _encoded(self, new: list[str]) -> list[bytes]:
        """Ids of pieces by the whole encoder."""
        if not self.specials:
            found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        mark, mark_id = next(iter(self.specials.items()))
        joined = [mark.join(new[b : b + self.JOINED]) for b in range(0, len(new), self.JOINED)]
        out: list[bytes] = []
        for encoding in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            cuts = np.flatnonzero(ids == mark_id)
            begins, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            out += [data[b:e] for b, e in zip(begins, ends)]
        return out


class _Whole:
    """The tokenizers library on whole texts, for all other vocabularies."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        return self.encode(texts.to_pylist())


@lru_cache(maxsize=2)
def encoder(path: str):
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter = spec.get("pre_tokenizer") or {}
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    return _Library(path) if plain and not spec.get("normalizer") else _Whole(path)


def id_width(path: str) -> int:
    """Bytes of an id in files of a vocabulary."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 else 4


def write_tokens(docs: DataFrame, target: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into a token table at ``target``; returns its manifest.

    Documents are in ascending order of doc_id, rows of one doc_id in order of
    text, nulls first, and a null doc_id is read back as null; ``end_id`` follows each. A null text counts as empty. An
    empty table gives parts without documents. Other columns are ignored.
    """

    width = max(id_width(tokenizer_path), 2 if end_id < 1 << 16 else 4)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = folder(target)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer_path).encode_column
        counts, ids_of, without_id = [np.zeros(1, np.int64)], [], 0
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{name}.ids") as out:
            for batch in batches:
                without_id += batch.column(0).null_count
                ids_of.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for start, rows in text_slices(batch.column(1), SLICE_BYTES):
                    encoded = encode(batch.column(1).slice(start, rows))
                    counts.append(np.array([len(e) + 1 for e in encoded], np.int64))
                    end = np.array([end_id], "<u4")
                    if encoded:
                        out.write(np.concatenate([x for e in encoded for x in (e, end)]).astype(kind).tobytes())
        offsets = np.cumsum(np.concatenate(counts)).astype("<i8")
        with system.open_output_stream(f"{root}/{name}.offsets") as out:
            out.write(offsets.tobytes())
        with system.open_output_stream(f"{root}/{name}.docs") as out:
            out.write(b"".join(x.tobytes() for x in ids_of))
        row = {"part": [part], "name": [name], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "width": [width], "n_null": [without_id]}
        yield pa.RecordBatch.from_pydict(row, MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST_SCHEMA).write.parquet(f"{target}/manifest")
    return docs.sparkSession.read.parquet(f"{target}/manifest")


def _mapped(system: fs.FileSystem, path: str) -> memoryview:
    """A file's bytes, memory-mapped where it is local."""
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as file:
            file.seek(0, 2)
            return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)) if file.tell() else memoryview(b"")
    with system.open_input_file(path) as file:
        return memoryview(file.read())


def documents_of(system: fs.FileSystem, root: str, name: str, width: int, n_null: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset in the part, its ids) of each document of a part."""
    ids = np.frombuffer(_mapped(system, f"{root}/{name}.ids"), f"<u{width}")
    offsets = np.frombuffer(_mapped(system, f"{root}/{name}.offsets"), "<i8").tolist()
    docs = np.frombuffer(_mapped(system, f"{root}/{name}.docs"), "<i8").tolist()
    docs[:n_null] = [None] * n_null
    for doc, begin, end in zip(docs, offsets, offsets[1:]):
        yield doc, begin, ids[begin:end]


def read_digests(spark, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token table, from its files."""
    manifest = spark.read.parquet(f"{target}/manifest").where("n_docs > 0")
    n = max(1, manifest.count())
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = manifest.select("name", F.coalesce(before, F.lit(0)).alias("base"), "width", "n_null").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = folder(target)
        for batch in batches:
            for name, base, width, n_null in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found = documents_of(system, root, name, width, n_null)
                rows = [(doc, base + at, len(ids), zlib.crc32(ids.astype("<u4"))) for doc, at, ids in found]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    """A new folder for a token table among the session's shared files."""
    return scratch_path(spark, "tokens")
