"""6. Removal of repeated byte strings by distributed prefix doubling.

A position's rank at length h stands for the h bytes that begin there; ranks at 2h (or a
little less, with an overlap) come from pairs of ranks at a growing offset. A position whose
rank no other document has at some length repeats nothing, and leaves. The lengths are 8
and 16 bytes, then 33, then the threshold of 50. Inside a task the ranks are 64-bit names made
from the pair; across documents Spark deals them out by name and tasks sort them.

To rank at every position would shuffle twenty bytes per byte of text. Instead the first round
takes, for each window of 50 bytes, its 16 bytes of least rank: equal windows take the same,
and neighbouring windows mostly agree, so one row stands for about 19 windows (a piece), with
a name of all the bytes that its windows cover.

1. Pieces meet by their 16-byte rank. Unique ones leave. Of equal pieces all but the smallest
   document's are repeats, whole. Pieces of one rank that differ go on, one for each content.
2. Their windows are ranked at 33 bytes (the 16 and half of the rest, before or after), and
   unique ones leave.
3. What is left is ranked at 50 bytes from pairs at offset 25: a window is a repeat where a
   smaller document has the same.

A string that very many documents have, each in other surroundings, would bring as many rows
to one task. Where one slice of the input holds ``HOT`` different contents of a rank, the rank
is hot: its pieces are dealt by content instead, two of them tell the others of that rank, and
all its windows go straight to round 3, where they are dealt by their 50 bytes. Equal pieces
and windows of a slice are one row before any shuffle.

Repeats come back to their document as (first window, number of windows) and the covered
bytes are cut out, as judged on the input. A null text is empty. Texts without a doc_id are
left whole and are no source of repeats. Repeated rows get the same result; rows that share
a doc_id and have different texts lose the places that repeat in any of them. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import map_texts, slices, write_once

SIZE, ANCHOR = 50, 16
#: Bytes handled at once inside a task, so the arrays stay in the processor's cache.
CHUNK = 1 << 18
#: Contents of one rank in one slice from which the rank is hot.
HOT = 16
#: Windows of a piece at most.
_LONGEST = 50
_U = np.uint64


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of two names in order."""
    x = a * _U(0x9E3779B97F4A7C15) ^ (b * _U(0xC2B2AE3D27D4EB4F) + (a >> _U(31)))
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | x[shift:] << _U(8 * shift)
    return x


def doubled(names: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Names at ``wanted`` bytes from names at ``size``, by pairs at doubling offsets."""
    while size < wanted:
        step = min(size, wanted - size)
        names, size = pair(names[:-step], names[step:]), size + step
    return names


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x, n = np.minimum(x[:-step], x[step:]), n + step
    return x


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the first minimum of each ``width`` neighbours."""
    at, n = np.arange(len(x)), 1
    while n < width:
        step = min(n, width - n)
        left, right = at[:-step], at[step:]
        at, n = np.where(x[right] < x[left], right, left), n + step
    return at


def chunks(texts: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at least ``SIZE`` bytes, put together up to ``CHUNK`` bytes; longer ones are
    cut so that every window is in one chunk. Yields bytes, and of each part of a text: its
    place in the bytes, the text's number, its place in the text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def ready():
        lengths = np.array([len(b) for _, _, b in held])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        return data, starts, np.array([t for t, _, _ in held]), np.array([o for _, o, _ in held], np.int64)

    for number, text in texts:
        for at in range(0, max(1, len(text) - SIZE + 1), CHUNK):
            part = text[at : at + CHUNK + SIZE - 1]
            if len(part) < SIZE:
                continue
            if held and size + len(part) > CHUNK:
                yield ready()
                held, size = [], 0
            held.append((number, at, part))
            size += len(part)
    if held:
        yield ready()


def runs(same: np.ndarray, starts: np.ndarray, longest: int = _LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with equal values of ``same``, inside one part of a text: first
    window, number of windows (at most ``longest``), part."""
    begins = np.concatenate([[True], same[1:] != same[:-1]])
    begins[starts[:-1]] = True
    first = np.flatnonzero(begins)
    part = np.searchsorted(starts, first, side="right") - 1
    n = np.minimum(np.append(first[1:], len(same)), starts[part + 1] - SIZE + 1) - first
    first, part, n = first[n > 0], part[n > 0], n[n > 0]
    if len(n) and n.max() > longest:
        many = -(-n // longest)
        step = longest * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        first, part, n = np.repeat(first, many) + step, np.repeat(part, many), np.minimum(longest, np.repeat(n, many) - step)
    return first, n, part


def pack(*columns: np.ndarray) -> bytes:
    """Columns byte by byte (all first bytes, then all second ones, ...), which compresses."""
    n = np.array([len(columns[0])], np.int64).tobytes()
    return n + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)


def unpack(data: bytes, types: list) -> tuple[list[np.ndarray], bytes]:
    """The columns, and what follows them."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for t in map(np.dtype, types):
        raw = np.frombuffer(data, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).reshape(-1).view(t))
        at += n * t.itemsize
    return out, data[at:]


# Kinds of packed rows: places known to repeat; rows dealt by rank; rows dealt by content.
KNOWN, BY_RANK, BY_CONTENT = 0, 1, 2
# Of a piece: 40 bits of its rank (the bucket may hold more of them), 48 of its content's name,
# document (difference to the row before), first window, number of windows, whether it is hot.
PIECE = [np.uint32, np.uint8, np.uint32, np.uint16, np.int64, np.uint32, np.uint8, np.uint8]
# Of windows at 33 bytes: 40 bits of their rank, document, first window, number of windows.
SPAN = [np.uint32, np.uint8, np.int64, np.uint32, np.uint8]
# Of a window at 50 bytes: its rank's two halves, document, place.
WINDOW = [np.uint64, np.uint64, np.int64, np.uint32]
REPEAT = [np.int64, np.uint32, np.uint8]
Packed = tuple[int, int, bytes]


def high40(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x >> _U(32)).astype(np.uint32), (x >> _U(24)).astype(np.uint8)


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.int64(0))


def codes(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 8 | n.astype(np.int64)


def pieces_of(doc: list, text: list) -> tuple[np.ndarray, ...]:
    """rank, content, document, first window, number of windows of every piece."""
    ids, out = np.array(doc, np.int64), []
    half = -(-SIZE // 2)
    for data, starts, number, offset in chunks(list(enumerate(text))):
        sixteen = doubled(eights(data), 8, ANCHOR)
        rank = least(sixteen, SIZE - ANCHOR + 1)
        first, n, part = runs(rank, starts)
        name = doubled(sixteen, ANCHOR, half)
        last, rest = first + n - 1, SIZE - half
        content = pair(pair(name[first], name[first + rest]), pair(name[last], name[last + rest])) + n.astype(np.uint64)
        out.append((rank[first], content, ids[number[part]], offset[part] + first - starts[part], n))
    empty = [np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    return tuple(np.concatenate(c) for c in zip(empty, *out))


def _bucketed(kind: int, bucket: np.ndarray, make: Callable[[np.ndarray], bytes]) -> Iterator[Packed]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield kind, int(bucket[order[a]]), make(order[a:b])


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys begins, in rows sorted by them."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def not_smallest(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rows for which a smaller document has the same keys."""
    order = np.lexsort((doc, *keys))
    new = heads(*(k[order] for k in keys))
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(doc) else out
    return out


def _first_pieces(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[Packed]:
    """Round 1, map side."""
    turn = 0
    for batch in batches:
        for part in slices(batch):
            rank, content, doc, first, n = pieces_of(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            if not len(rank):
                continue
            known = not_smallest(doc, content, rank)
            if known.any():
                turn += 1
                yield KNOWN, (turn + int(doc[0])) % buckets, pack(delta(doc[known]), first[known].astype(np.uint32), n[known].astype(np.uint8))
            rank, content, doc, first, n = (x[~known] for x in (rank, content, doc, first, n))
            hot, told = hot_ranks(rank, content, doc)

            def block(i: np.ndarray) -> bytes:
                return pack(
                    *high40(rank[i]), (content[i] >> _U(32)).astype(np.uint32), (content[i] >> _U(16)).astype(np.uint16),
                    delta(doc[i]), first[i].astype(np.uint32), n[i].astype(np.uint8), hot[i].astype(np.uint8),
                )

            for kind, chosen, by in ((BY_RANK, ~hot | told, rank), (BY_CONTENT, hot, content)):
                rows = np.flatnonzero(chosen)
                yield from _bucketed(kind, (by[rows] % _U(buckets)).astype(np.int64), lambda i, rows=rows: block(rows[i]))


def hot_ranks(rank: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ranks with ``HOT`` contents in several documents; of each such rank the rows of
    the smallest and the largest document, which differ in content as well."""
    order = np.lexsort((doc, content, rank))
    new = heads(rank[order])
    edges, group = np.flatnonzero(new), np.cumsum(new) - 1
    contents = np.add.reduceat(heads(rank[order], content[order]).astype(np.int64), edges) if len(edges) else edges
    low = np.minimum.reduceat(doc[order], edges) if len(edges) else edges
    high = np.maximum.reduceat(doc[order], edges) if len(edges) else edges
    hot, told = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    hot[order] = ((contents >= HOT) & (low < high))[group]
    told[order] = (doc[order] == low[group]) | (doc[order] == high[group])
    return hot, hot & told


def _meet(rows: list[Packed], types: list) -> list[np.ndarray]:
    """All rows of a kind in a task; the bucket comes first. Documents are differences."""
    cut = [(b, *unpack(x, types)[0]) for _, b, x in rows]
    at = types.index(np.int64)
    columns = [np.concatenate([np.full(len(c[1]), c[0]) for c in cut])]
    for i in range(len(types)):
        columns.append(np.concatenate([np.cumsum(c[1 + i]) if i == at else c[1 + i] for c in cut]))
    return columns


def judge_pieces(rows: list[Packed]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Round 1, after the shuffle: document, code, and 0 for a repeat, 1 for a piece that goes
    on, 2 for one of a hot rank."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
    if known := [x for x in rows if x[0] == KNOWN]:
        _, d, first, n = _meet(known, REPEAT)
        out.append((d, codes(first, n), np.zeros(len(d), np.int32)))
    for kind in (BY_RANK, BY_CONTENT):
        if not (own := [x for x in rows if x[0] == kind]):
            continue
        bucket, r0, r1, c0, c1, d, first, n, hot = _meet(own, PIECE)
        rank = bucket.astype(np.uint64) << _U(40) | r0.astype(np.uint64) << _U(8) | r1
        content = c0.astype(np.uint64) << _U(16) | c1
        repeat = not_smallest(d, content, rank)
        if kind == BY_CONTENT:
            more = np.where(repeat, 0, 2)
        else:
            order = np.lexsort((d, content, rank))
            new = heads(rank[order])
            edges, group = np.flatnonzero(new), np.cumsum(new) - 1
            differ = np.add.reduceat(heads(rank[order], content[order]).astype(np.int64), edges) > 1
            several = np.minimum.reduceat(d[order], edges) < np.maximum.reduceat(d[order], edges)
            told = np.maximum.reduceat(hot[order], edges) > 0
            more = np.zeros(len(d), np.int32)
            more[order] = np.where(differ & several, 1 + told, -1)[group]
            more[repeat] = 0
        kept = more >= 0
        out.append((d[kept], codes(first[kept], n[kept]), more[kept].astype(np.int32)))
    doc, code, more = (np.concatenate(c) for c in zip(*out))
    return doc, code, more


def _cut_out(doc: list, text: list, found: list[list[int]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The bytes of the coded windows, their document and first place."""
    cut, owner, place = [], [], []
    for d, t, coded in zip(doc, text, found):
        for code in sorted(set(coded)):
            first, n = code >> 8, code & 255
            cut.append(t[first : first + n + SIZE - 1])
            owner.append(d)
            place.append(first)
    return cut, np.array(owner, np.int64), np.array(place, np.int64)


def _spans(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[Packed]:
    """Rounds 2 and 3, map side. ``codes``: twice the code, and one more for a hot rank."""
    for batch in batches:
        for part in slices(batch):
            doc, text, found = (part.column(c).to_pylist() for c in ("doc_id", "text", "codes"))
            plain = [[c >> 1 for c in x if not c & 1] for x in found]
            hot = [[c >> 1 for c in x if c & 1] for x in found]
            yield from _by_33_bytes(*_cut_out(doc, text, plain), buckets)
            yield from _by_50_bytes(*_cut_out(doc, text, hot), buckets)


def _by_33_bytes(cut: list[bytes], doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[Packed]:
    beside, made = (SIZE - ANCHOR) // 2, []
    for data, starts, number, _ in chunks(list(enumerate(cut))):
        sixteen = doubled(eights(data), 8, ANCHOR)
        anchor = least_at(sixteen, SIZE - ANCHOR + 1)
        key = np.where(anchor - np.arange(len(anchor)) >= beside, anchor - beside, anchor)
        rank = pair(sixteen[:-beside], sixteen[beside:])
        first, n, seg = runs(key, starts)
        text = data.tobytes()
        blobs = [text[a : a + b + SIZE - 1] for a, b in zip(first.tolist(), n.tolist())]
        made.append((rank[key[first]], doc[number[seg]], place[number[seg]] + first - starts[seg], n, blobs))
    if not made:
        return
    rank, owner, first, n = (np.concatenate([m[i] for m in made]) for i in range(4))
    blobs = [b for m in made for b in m[4]]

    def block(i: np.ndarray) -> bytes:
        head = pack(*high40(rank[i]), delta(owner[i]), first[i].astype(np.uint32), n[i].astype(np.uint8))
        return head + b"".join([blobs[k] for k in i.tolist()])

    yield from _bucketed(BY_RANK, (rank % _U(buckets)).astype(np.int64), block)


def _by_50_bytes(cut: list[bytes], doc: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[Packed]:
    half, made = -(-SIZE // 2), []
    for data, starts, number, _ in chunks(list(enumerate(cut))):
        name = doubled(doubled(eights(data), 8, ANCHOR), ANCHOR, half)
        seg = np.repeat(np.arange(len(number)), np.diff(starts))
        at = np.flatnonzero(np.arange(len(data)) + SIZE <= starts[seg + 1])
        seg = seg[at]
        made.append((name[at], name[at + SIZE - half], doc[number[seg]], place[number[seg]] + at - starts[seg]))
    if not made:
        return
    a, b, owner, at = (np.concatenate([m[i] for m in made]) for i in range(4))
    known = not_smallest(owner, b, a)
    if known.any():
        d, code = _joined(owner[known], at[known])
        yield KNOWN, int(d[0]) % buckets, pack(delta(d), (code >> 8).astype(np.uint32), (code & 255).astype(np.uint8))
    a, b, owner, at = (x[~known] for x in (a, b, owner, at))
    yield from _bucketed(
        BY_CONTENT,
        (a % _U(buckets)).astype(np.int64),
        lambda i: pack(a[i], b[i], delta(owner[i]), at[i].astype(np.uint32)),
    )


def judge_spans(rows: list[Packed]) -> tuple[np.ndarray, np.ndarray]:
    """Rounds 2 and 3, after the shuffle: document and code of the windows that repeat."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if known := [x for x in rows if x[0] == KNOWN]:
        _, d, first, n = _meet(known, REPEAT)
        out.append((d, codes(first, n)))
    if own := [x for x in rows if x[0] == BY_CONTENT]:
        _, a, b, d, at = _meet(own, WINDOW)
        repeat = not_smallest(d, b, a)
        out.append(_joined(d[repeat], at[repeat].astype(np.int64)))
    if own := [x for x in rows if x[0] == BY_RANK]:
        out.append(_judge_33(own))
    doc, code = (np.concatenate(c) for c in zip(*out))
    return doc, code


def _judge_33(rows: list[Packed]) -> tuple[np.ndarray, np.ndarray]:
    bucket, r0, r1, doc, first, n = _meet(rows, SPAN)
    rank = bucket.astype(np.uint64) << _U(40) | r0.astype(np.uint64) << _U(8) | r1
    data = np.frombuffer(b"".join(unpack(x, SPAN)[1] for _, _, x in rows), np.uint8)
    size = n.astype(np.int64) + SIZE - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((doc, rank))
    new = heads(rank[order])
    edges, d = np.flatnonzero(new), doc[order]
    several = (np.minimum.reduceat(d, edges) < np.maximum.reduceat(d, edges))[np.cumsum(new) - 1]
    left = order[several]
    half, found = -(-SIZE // 2), []
    step = 0
    while step < len(left):  # names of about a chunk of bytes at a time
        ends = np.cumsum(size[left[step : step + CHUNK // SIZE + 1]])
        block = left[step : step + max(1, int(np.searchsorted(ends, CHUNK)))]
        step += len(block)
        s = size[block]
        place = np.repeat(begin[block] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        name = doubled(doubled(eights(data[place]), 8, ANCHOR), ANCHOR, half)
        many = n[block].astype(np.int64)
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(np.cumsum(s) - s, many) + k
        found.append((name[at], name[at + SIZE - half], np.repeat(doc[block], many), np.repeat(first[block].astype(np.int64), many) + k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, d, at = (np.concatenate([f[i] for f in found]) for i in range(4))
    repeat = not_smallest(d, b, a)
    return _joined(d[repeat], at[repeat])


def _joined(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows to codes of neighbouring ones; a window may be there twice."""
    if not len(doc):
        return doc, at
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
    edges = np.flatnonzero(new)
    last = np.append(edges[1:], len(doc)) - 1
    return _short(doc[edges], at[edges], at[last] - at[edges] + 1)


def _short(doc: np.ndarray, first: np.ndarray, n: np.ndarray, longest: int = 255) -> tuple[np.ndarray, np.ndarray]:
    many = -(-n // longest)
    step = longest * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    return np.repeat(doc, many), codes(np.repeat(first, many) + step, np.minimum(longest, np.repeat(n, many) - step))


def covered(found: list[int], size: int) -> list[tuple[int, int]]:
    """Spans of bytes that the coded windows cover."""
    if not found:
        return []
    code = np.sort(np.array(found, np.int64))
    a = np.minimum(code >> 8, size)
    b = np.minimum(np.maximum.accumulate((code >> 8) + (code & 255) + SIZE - 1), size)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    edges = np.flatnonzero(new)
    ends = b[np.append(edges[1:], len(b)) - 1]
    return [(x, y) for x, y in zip(a[edges].tolist(), ends.tolist()) if x < y]


def _dealt(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch], int], Iterator[Packed]]) -> DataFrame:
    """Packed rows from ``work``, one bucket to a task. Twice as many buckets as usual, as a
    task unpacks its rows into arrays."""
    n = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, bucket, data in work(batches, n):
            columns = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "data"])

    return df.mapInArrow(run, "kind int, bucket int, data binary").repartitionById(n, "bucket")


def _judged(packed: DataFrame, schema: str, judge: Callable[[list[Packed]], tuple]) -> DataFrame:
    """All rows of a kind and bucket through ``judge``, one kind after another."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[Packed]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[:2], []).append(row)
            del batch
        for key in sorted(held):
            made = judge(held.pop(key))
            for k in range(0, len(made[0]), 1 << 16):
                yield pa.RecordBatch.from_pydict({c: x[k : k + (1 << 16)] for c, x in zip(names, made)})

    return packed.mapInArrow(run, schema)


def repeats(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id bigint, text binary, perhaps more; no nulls among the ids):
    ``doc_id, code``, the windows of each document that a smaller doc_id has."""
    first = _dealt(texts.select("doc_id", "text"), _first_pieces)
    judged = write_once(_judged(first, "doc_id bigint, code bigint, more int", judge_pieces))
    on = judged.where("more > 0").select("doc_id", F.expr("2 * code + more - 1").alias("code"))
    more = on.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    # All columns of the texts, so that this shuffle of them and the last one are the same.
    spans = _dealt(texts.join(more, "doc_id"), _spans)
    return judged.where("more = 0").select("doc_id", "code").union(_judged(spans, "doc_id bigint, code bigint", judge_spans))


def _with_codes(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text, perhaps more) with ``codes``, an array or null."""
    known = texts.where("doc_id IS NOT NULL")
    found = repeats(known).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    columns = [*texts.columns, "codes"]
    told = known.join(found, "doc_id", "left").select(columns)
    return told.union(texts.where("doc_id IS NULL").withColumn("codes", F.lit(None).cast("array<bigint>")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> list:
    key = docs[id_col]  # an alias that Spark may drop in one place would make two shuffles
    return [
        key if (id_col, dict(docs.dtypes)[id_col]) == ("doc_id", "bigint") else key.cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"),
    ]


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(e for s in spans for e in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def without_repeats(docs: DataFrame, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans``, ``spans`` (byte offsets removed) and ``kept``
    (the remaining bytes); with ``digest``, ``kept_sha256`` in place of the last two."""

    def start():
        def work(batch: dict) -> dict:
            spans = [covered(c or [], len(t)) for t, c in zip(batch["text"], batch["codes"])]
            kept = [remaining(t, x) for t, x in zip(batch["text"], spans)]
            out = {
                "doc_id": batch["doc_id"],
                "n_bytes": [len(t) for t in batch["text"]],
                "n_removed": [len(t) - len(k) for t, k in zip(batch["text"], kept)],
                "n_spans": [len(x) for x in spans],
            }
            if digest:
                return out | {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            return out | {"spans": [[{"first": a, "end": b} for a, b in x] for x in spans], "kept": kept}

        return work

    last = "kept_sha256 string" if digest else "spans array<struct<first:bigint,end:bigint>>, kept binary"
    told = _with_codes(docs.select(*_texts(docs, id_col, text_col)))
    return map_texts(told, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last}", start)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeats cut out of its texts; other columns stay as they are, but
    for the length in characters of a text that was cut. Characters of which a cut leaves
    only some bytes go as well."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, codes: pd.Series) -> pd.Series:
        kept = [remaining(t, covered(list(c), len(t))) for t, c in zip(texts, codes)]
        return pd.Series([k.decode("utf-8", "ignore") for k in kept], dtype=object)

    names = [f"c{i}" for i in range(len(docs.columns))]
    positional = docs.toDF(*names)
    own = dict(zip(docs.columns, names))
    told = _with_codes(positional.select(*_texts(positional, own[id_col], own[text_col]), *names_but(names, own[text_col])))
    new = F.when(F.col("codes").isNotNull(), cut("text", F.coalesce("codes", F.array().cast("array<bigint>")))).otherwise(F.col("text").cast("string"))
    told = told.withColumn(own[text_col], new)
    if length_col in own:
        size = F.length(own[text_col]).cast(dict(docs.dtypes)[length_col])
        told = told.withColumn(own[length_col], F.when(F.col("codes").isNotNull(), size).otherwise(F.col(own[length_col])))
    return told.select(*(F.col(n).alias(c) for c, n in own.items()))


def names_but(names: list[str], name: str) -> list[str]:
    return [n for n in names if n != name]
