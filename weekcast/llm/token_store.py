"""8. Token ids in binary shards with a minimal perfect hash index.

Documents are dealt to ranges of ascending key; each range is encoded in key order and
written as blocks: the raw ids (little-endian unsigned 16-bit integers), and an index from
key to place. A block is one row of a Parquet file in the shared folder, so any store that
Spark writes to will do, and a reader asks for a block by its key range.

The index is a minimal perfect hash: on every level each remaining key hashes to a bit, and
keys that are alone on their bit stop there; a key's slot is the number of set bits before
its own, for which counts are stored every 512 bits. Slot by slot the index holds a
fingerprint of the key, its first row and the number of its rows, and row by row the place of
the ids, so a lookup costs a few bit tests and one comparison, whatever the block's size.

A null text has no ids but the end id. Rows with a null key are written but can't be looked
up. Where a key is repeated, its rows stand side by side, in one block or in several whose
ranges share it, and each index names the first and their number. An empty table gives empty
files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekcast.llm.common import Remembered, keyed_texts, new_folder, slices, write_once

FILE = "word_bpe_49k.json"
END_ID = 1
#: Ids of a block at most, but for one document that has more.
BLOCK_IDS = 1 << 20
_GAMMA = 1.5


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The library's encoding, word by word. This kind of vocabulary drops white space and
    never joins characters across it, so a text is encoded as its words one after another."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known = Remembered()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True

    def _library(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u2").tobytes() for x in found]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only are one piece each, so many go to the library as one text
        and are told apart by the pieces' last ids."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            block = words[k : k + 2000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)
            ids = np.array(found.ids, "<u2")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(block):
                out += self._library(block)
            else:
                bounds = [0, *(2 * last).tolist()]
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _make(self, words: list[str]) -> list[bytes]:
        """A word is often letters and a stop after them, which are two pieces."""
        heads = [w if w.isalpha() else w.rstrip(".,;:!?") for w in words]
        plain = [h.isalpha() for h in heads]
        had = {h: x for h, p in zip(heads, plain) if p and (x := self.known.get(h)) is not None}
        letters = dict.fromkeys(h for h, p in zip(heads, plain) if p and h not in had)
        rest = dict.fromkeys(w for w, p in zip(words, plain) if not p)
        rest |= dict.fromkeys(w[len(h) :] for w, h, p in zip(words, heads, plain) if p and len(h) < len(w))
        ids = had | dict(zip(letters, self._letters(list(letters))))
        others = dict(zip(rest, self._library(list(rest))))
        return [
            (ids[h] + others[w[len(h) :]] if len(h) < len(w) else ids[h]) if p else others[w]
            for w, h, p in zip(words, heads, plain)
        ]

    def encode_many(self, texts: pa.Array | Iterable[str]) -> list[bytes]:
        """Ids of each text. Arrow cuts the texts into words and numbers the different ones; their
        ids, taken by number, lie side by side as the texts' ids."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        named = cut.flatten().dictionary_encode()
        words = named.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.known.lookup(set(words), self._make)
        raw = pa.array([ids[w] for w in words], pa.large_binary()).take(named.indices)
        _, at, data = raw.buffers()
        if data is None:
            return [b""] * len(texts)
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        ends = np.frombuffer(at, np.int64)[raw.offset + first].tolist()
        held = memoryview(data)
        return [bytes(held[a:b]) for a, b in zip(ends, ends[1:])]


@cache
def encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordEncoder(path)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 1_000_000) >> np.uint64(32)).astype(np.uint32)


#: Bits between two stored rank counts, and the bytes that hold them.
_STRIDE = 512
_STRIDE_BYTES = _STRIDE // 8
_AT_ONCE = 1 << 14
_ONES = np.array([x.bit_count() for x in range(256)], np.uint8)


@dataclass
class PerfectHash:
    """Packed bits of all levels one after another, the length of each level, and the number
    of set bits before every ``_STRIDE``-th bit: a key costs one stride per level at most."""

    bits: np.ndarray
    sizes: list[int]
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct 64-bit integers."""
        left, levels, sizes = keys.astype(np.int64).view(np.uint64), [], []
        while len(left):
            size = max(64, int(len(left) * _GAMMA))
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
        bits = np.concatenate([bits, np.zeros(-len(bits) % _STRIDE_BYTES, np.uint8)])
        per_stride = _ONES[bits].reshape(-1, _STRIDE_BYTES).sum(axis=1, dtype=np.int64)
        return cls(bits, sizes, np.cumsum(per_stride) - per_stride)

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before the places ``at``."""
        stride = at // _STRIDE
        window = self.bits[(stride * _STRIDE_BYTES)[:, None] + np.arange(_STRIDE_BYTES)]
        inside = at % _STRIDE
        whole = np.arange(_STRIDE_BYTES) < (inside // 8)[:, None]
        last = window[np.arange(len(at)), inside // 8] >> (8 - inside % 8).astype(np.uint8)
        return self.ranks[stride] + (_ONES[window] * whole).sum(axis=1, dtype=np.int64) + _ONES[last]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not built in."""
        keys = keys.astype(np.int64).view(np.uint64)
        pieces = [self._slots(keys[k : k + _AT_ONCE]) for k in range(0, len(keys), _AT_ONCE)]
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int64)

    def _slots(self, left: np.ndarray) -> np.ndarray:
        out = np.full(len(left), -1, np.int64)
        rows, base = np.arange(len(left)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mix(left, level) % np.uint64(size)).astype(np.int64)
            hit = (self.bits[at // 8] >> (7 - at % 8).astype(np.uint8)) & 1 == 1
            out[rows[hit]] = self._rank(at[hit])
            rows, left, base = rows[~hit], left[~hit], base + size
        return out


# part: place of the range in key order; before: ids of earlier blocks of the same part;
# keys: the keys of the rows in order; starts: of the rows' ids in the block, and their end;
# ranks: set bits before every stride; marks, slot_rows, slot_copies: by slot of the index.
BLOCK = (
    "part int, block int, before bigint, n_ids bigint, n_rows bigint, n_null_keys bigint, low_key bigint,"
    " high_key bigint, ids binary, keys binary, starts binary, level_sizes array<bigint>, bits binary,"
    " ranks binary, marks binary, slot_rows binary, slot_copies binary"
)


def _block(part: int, number: int, before: int, keys: list, ids: list[bytes]) -> dict:
    lengths = np.array([len(x) // 2 for x in ids], np.int64)
    nulls = sum(k is None for k in keys)
    known = np.array(keys[nulls:], np.int64)
    distinct, row, copies = np.unique(known, return_index=True, return_counts=True)
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    marks, rows, many = (np.zeros(len(distinct), t) for t in (np.uint32, np.int64, np.int64))
    marks[slots], rows[slots], many[slots] = fingerprints(distinct), row + nulls, copies
    return {
        "part": part,
        "block": number,
        "before": before,
        "n_ids": int(lengths.sum()),
        "n_rows": len(keys),
        "n_null_keys": nulls,
        "low_key": int(distinct[0]) if len(distinct) else None,
        "high_key": int(distinct[-1]) if len(distinct) else None,
        "ids": b"".join(ids),
        "keys": known.tobytes(),
        "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64).tobytes(),
        "level_sizes": index.sizes,
        "bits": index.bits.tobytes(),
        "ranks": index.ranks.tobytes(),
        "marks": marks.tobytes(),
        "slot_rows": rows.tobytes(),
        "slot_copies": many.tobytes(),
    }


def write_store(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the blocks to ``folder``. One shuffle, of the texts by range
    of key and text hash, so that different texts of one key are no hot spot."""
    texts = keyed_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    out = docs.sparkSession.createDataFrame([], BLOCK).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, words = to_arrow_schema(out), encoder(path or tokenizer_path())
        end = np.array([END_ID], "<u2").tobytes()
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys, ids, held = [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(part, number, before, keys, ids)], schema=arrow)

        for batch in batches:
            for piece in slices(batch, 16 << 20):
                made = words.encode_many(piece.column("text"))
                for key, x in zip(piece.column("doc_id").to_pylist(), made):
                    n = len(x) // 2 + 1
                    if held and held + n > BLOCK_IDS:
                        yield full()
                        number, before, keys, ids, held = number + 1, before + held, [], [], 0
                    keys.append(key)
                    ids.append(x + end)
                    held += n
        if keys:
            yield full()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, out).write.option("compression", "zstd").parquet(folder)


class Block:
    """A block read back. Its arrays are views of the batch's bytes; nothing is unpacked."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.batch, self.row = batch, row
        self.index = PerfectHash(self.array("bits", np.uint8), self.value("level_sizes"), self.array("ranks", np.int64))
        self.ids = self.array("ids", "<u2")
        self.starts = self.array("starts", np.int64)
        self.marks = self.array("marks", np.uint32)
        self.rows = self.array("slot_rows", np.int64)
        self.copies = self.array("slot_copies", np.int64)

    def value(self, name: str):
        return self.batch.column(name)[self.row].as_py()

    def array(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self.batch.column(name)[self.row].as_buffer(), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row of each key and the number of its rows; -1 and 0 for keys not stored
        (but for one in four thousand million, which has a stored key's fingerprint)."""
        slots = self.index.slots(keys)
        ok = slots >= 0
        ok[ok] = self.marks[slots[ok]] == fingerprints(keys[ok])
        first, many = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        first[ok], many[ok] = self.rows[slots[ok]], self.copies[slots[ok]]
        return first, many

    def of_row(self, row: int) -> np.ndarray:
        return self.ids[self.starts[row] : self.starts[row + 1]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch, k)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``. Every key
    is looked up through the index of its block."""
    blocks = spark.read.parquet(folder).drop("low_key", "high_key", "block")
    out = spark.createDataFrame([], "doc_id bigint, part int, place bigint, n_tokens bigint, ids_crc32 bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in _blocks(batches):
            keys = np.unique(b.array("keys", np.int64))
            first, many = b.find(keys)
            rows = [(None, i) for i in range(b.value("n_null_keys"))]
            rows += [(k, f + j) for k, f, n in zip(keys.tolist(), first.tolist(), many.tolist()) for j in range(n)]
            part, before = b.value("part"), b.value("before")
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": [k for k, _ in rows],
                    "part": [part] * len(rows),
                    "place": [before + int(b.starts[i]) for _, i in rows],
                    "n_tokens": [int(b.starts[i + 1] - b.starts[i]) for _, i in rows],
                    "ids_crc32": [zlib.crc32(b.of_row(i).astype("<u4").tobytes()) for _, i in rows],
                },
                schema=arrow,
            )

    # One total per range: as many rows as there are partitions, not documents.
    totals = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = blocks.mapInArrow(run, out).join(bases, "part")
    return rows.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


#: Keys that one copy of a block is asked for.
ASKED = 1 << 16


def _asked(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """``part, block, asked``: the blocks that may hold each key, in lists of at most ``ASKED``
    keys. A binary search over the ranges of the parts, as many as there were tasks when the
    store was written, gives the part; there, the number of blocks that begin at or before the
    key, and of those that end before it, bound its blocks (several where a repeated key
    spans them)."""
    ranges = blocks.groupBy("part").agg(F.min("low_key").alias("low"), F.max("high_key").alias("high")).orderBy("low", "part").collect()
    parts, lows, highs = (np.array([r[c] for r in ranges], np.int64) for c in ("part", "low", "high"))

    def between(batches):
        for batch in batches:
            x = batch["key"].to_numpy()
            first, end = np.searchsorted(highs, x, "left"), np.searchsorted(lows, x, "right")
            many = np.maximum(end - first, 0)
            at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield batch.iloc[np.repeat(np.arange(len(x)), many)].assign(part=parts[at].astype(np.int32))

    wanted = keys.mapInPandas(between, "key bigint, part int")
    edges = blocks.select("part", "block", F.inline(F.expr("array(struct(low_key AS key, 0 AS kind), struct(high_key AS key, 2 AS kind))")))
    # At equal keys a block begins before, and ends after, the key that is asked for.
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = wanted.withColumns({"block": F.lit(None).cast("int"), "kind": F.lit(1)}).unionByName(edges)
    placed = events.select(
        "part",
        "key",
        "kind",
        F.max(F.when(F.col("kind") == 0, F.col("block"))).over(so_far).alias("latest"),
        F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(so_far).alias("begun"),
        F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).over(so_far).alias("ended"),
        F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(so_far).alias("n"),
    ).where("kind = 1 AND begun > ended")
    each = placed.select("part", "key", "n", F.explode(F.expr("sequence(CAST(latest - begun + ended + 1 AS INT), latest)")).alias("block"))
    return each.groupBy("part", "block", F.floor(F.col("n") / ASKED)).agg(F.collect_list("key").alias("asked")).select("part", "block", "asked")


def lookup(spark: SparkSession, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` of the given keys, a row per stored row: each key is led to its block and
    found there through the index. Null keys and keys that are not stored give no row."""
    blocks = spark.read.parquet(folder).where("low_key IS NOT NULL")
    wanted = keys.select(keys[key_col].cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
    asked = write_once(_asked(blocks.select("part", "block", "low_key", "high_key"), wanted))
    parts = [r["part"] for r in asked.select("part").distinct().collect()]  # no more than tasks wrote the store
    out = spark.createDataFrame([], "doc_id bigint, ids array<int>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in _blocks(batches):
            keys = np.array(b.value("asked"), np.int64)
            first, many = b.find(keys)
            found = [(k, b.of_row(f + j)) for k, f, n in zip(keys.tolist(), first.tolist(), many.tolist()) for j in range(n)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [k for k, _ in found], "ids": [x.astype(np.int32) for _, x in found]}, schema=arrow
            )

    held = blocks.drop("keys", "before", "n_ids", "n_rows", "n_null_keys", "low_key", "high_key")
    return held.where(F.col("part").isin(parts)).join(asked, ["part", "block"]).mapInArrow(run, out)


def store_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = new_folder(docs.sparkSession)
    write_store(docs, folder, path)
    return read_store(docs.sparkSession, folder)
