"""Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Fingerprints of 64 bits can't promise that: such pairs differ in some ten bits on average and
in 17 now and then, more than a pigeonhole partition reaches at a fair price. Here the
pigeonhole is the set itself: in one order of all shingles, two sets that are similar enough
share one among their first ``n - ceil(0.8 n) + 1``. Rare shingles come first; how often each
is used is counted on a bounded sample, which steers the cost and never the result.

Equal sets are one node before any search. Nodes that share a shingle meet in a task, which
leaves out pairs whose sizes or places rule them out. A shingle that more than ``heavy`` nodes
share links them first to the node before and to the first one; only pairs that are in different
components after that are compared.

Most of the other pairs share a passage and little else. Each set has a bitmap of the parities of
its hashes, of at least a bit per shingle: sets differ in as many shingles as their bitmaps in
bits, or more. Pairs that this rules out never meet their texts, which go only to those that are
left; these are verified on the whole sets.

Words are lower-cased (ASCII) and parted at white space; a shorter text is one shingle, and
texts without words are equal. Shingles and sets go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import TEXT_ROWS, forget, map_texts, write_once
from weekcast.llm.components import components

WORDS, SEED = 5, 42
#: Least similarity as a fraction.
LEAST = (4, 5)
SAMPLE, FREQUENT, HEAVY, MARKS = 5_000, 1 << 16, 64, 1 << 23
#: Bytes of bitmaps that are compared at a time.
COMPARED = 8 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
POSTS = "shingle bigint, node bigint, n int, place int"
MET = "shingle bigint, a bigint, b bigint, place int"


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """The set as sorted hashes."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - n + 1)
    pairs = zip(starts[:last].tolist(), ends[min(n, len(words)) - 1 :].tolist())
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64).view(np.int64))


def node(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def first_shingles(found: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """As many of a set's rarest shingles as any similar set must have one of."""
    n, (num, den) = len(found), LEAST
    if not n:
        return found
    names, counts = often
    count = np.zeros(n, np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, found), len(names) - 1)
        count = np.where(names[at] == found, counts[at], 0)
    return found[np.lexsort((found, count))[: n - -(-num * n // den) + 1]]


def parities(found: np.ndarray) -> bytes:
    """A bitmap of the set: whether the shingles of a place are odd in number."""
    places = max(64, 1 << (max(1, len(found)) - 1).bit_length())
    return np.packbits(np.bincount(found & np.int64(places - 1), minlength=places) & 1).tobytes()


def differing(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows ``a`` and ``b`` of ``bits``: in how many shingles their sets differ at least. The
    larger bitmap is folded to the size of the smaller one."""
    size = np.array([len(x) for x in bits], np.int64)
    least, out = np.minimum(size[a], size[b]), np.zeros(len(a), np.int64)
    for k in np.unique(least).tolist():
        at = np.flatnonzero(least == k)
        rows, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, k // 8), axis=0) for r in rows])
        x, y, step = place[: len(at)], place[len(at) :], max(1, COMPARED // k)
        for n in range(0, len(at), step):
            other = folded[x[n : n + step]] ^ folded[y[n : n + step]]
            out[at[n : n + step]] = np.bitwise_count(other).sum(axis=1, dtype=np.int64)
    return out


def _alike(bits: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bitmaps leave it open that the sets are similar enough."""
    num, den = LEAST
    both = n[a] + n[b]
    return (both - differing(bits, a, b)) * (num + den) >= 2 * num * both


def text_key(docs: DataFrame, text_col: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.coalesce(docs[text_col].cast("binary"), F.lit(b"")), 256))


def _sets(docs: DataFrame) -> DataFrame:
    """``node, found`` of each row of ``docs`` (text)."""

    def start():
        def work(batch: dict) -> dict:
            made = [shingles(t or b"") for t in batch["text"]]
            return {"node": [node(s) for s in made], "found": made}

        return work

    return map_texts(docs.select(docs["text"].cast("binary").alias("text")), "node bigint, found array<bigint>", start)


def frequent(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more different texts of a sample, and in how many they are."""
    step = max(1, docs.count() // sample)
    some = _sets(docs.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0))
    once = some.groupBy("node").agg(F.first("found").alias("found"))
    counted = once.select(F.explode("found").alias("s")).groupBy("s").count().where("count > 1")
    top = sorted((r["s"], r["count"]) for r in counted.orderBy(F.desc("count"), "s").limit(FREQUENT).collect())
    return np.array([s for s, _ in top], np.int64), np.array([c for _, c in top], np.int64)


def keyed_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, node, n, rare, bits`` of every row: its set's name, size, first shingles
    and bitmap, which are null where the task has had them."""
    texts = docs.select(
        docs[id_col].alias("doc_id"), text_key(docs, text_col).alias("text_key"), docs[text_col].cast("binary").alias("text")
    )
    often = docs.sparkSession.sparkContext.broadcast(frequent(texts))

    def start():
        had: set[int] = set()

        def once(name: int, found: np.ndarray) -> tuple[np.ndarray | None, bytes | None]:
            if name in had:
                return None, None
            if len(had) >= 1 << 20:
                had.clear()
            had.add(name)
            return first_shingles(found, often.value), parities(found)

        def work(batch: dict) -> dict:
            made = [shingles(t or b"") for t in batch["text"]]
            names = [node(s) for s in made]
            rare, bits = zip(*(once(k, s) for k, s in zip(names, made))) if made else ((), ())
            return {
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "node": names,
                "n": [len(s) for s in made],
                "rare": list(rare),
                "bits": list(bits),
            }

        return work

    kind = dict(texts.dtypes)["doc_id"]
    return map_texts(texts, f"doc_id {kind}, text_key binary, node bigint, n int, rare array<bigint>, bits binary", start)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return begin, np.append(begin[1:], len(key))


def _pairs_of(begin: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within runs, about ``most`` at a time."""
    row = np.repeat(begin, size) + (within := np.concatenate([np.arange(s) for s in size]) if len(size) else size)
    total, at = np.cumsum(within), 0
    while at < len(row):
        done = total[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        n = within[at:last]
        right = np.repeat(row[at:last], n)
        left = np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(row[at:last] - n, n)
        yield left, right
        at = last


def _possible(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle has these places can be similar enough."""
    num, den = LEAST
    share = 1 + np.minimum(n[a] - place[a] - 1, n[b] - place[b] - 1)
    return share * (num + den) >= num * (n[a] + n[b])


def _map(rows: DataFrame, schema: str, work) -> DataFrame:
    """Rows with the same shingle meet in a task."""
    names, out = rows.columns, rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held = to_arrow_schema(out), {c: [] for c in names}
        for batch in batches:
            for c in names:
                held[c].append(batch.column(c).to_numpy(zero_copy_only=False))
        if held[names[0]]:
            for made in work(*(np.concatenate(held.pop(c)) for c in names)):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow)], schema=arrow)

    return rows.repartition("shingle").mapInArrow(run, out)


def _meet(heavy: int):
    """Pairs (place null), and the rows of shingles that more than ``heavy`` nodes share."""

    def work(shingle, name, n, place):
        order = np.lexsort((name, n, shingle))
        shingle, name = shingle[order], name[order]
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])])
        shingle, name, n, place = shingle[new], name[new], n[order][new].astype(np.int64), place[order][new].astype(np.int64)
        begin, end = _runs(shingle)
        size = end - begin
        some = (size > 1) & (size <= heavy)
        for a, b in _pairs_of(begin[some], size[some]):
            good = _possible(n, place, a, b)
            yield _as_pairs(name[a[good]], name[b[good]])
        for x, y in zip(begin[size > heavy], end[size > heavy]):
            b = np.arange(x + 1, y)
            for a in (b - 1, np.full(len(b), x)):
                good = _possible(n, place, a, b)
                yield _as_pairs(name[a[good]], name[b[good]])
            yield shingle[x:y], name[x:y], n[x:y], place[x:y]

    return work


def _as_pairs(a: np.ndarray, b: np.ndarray) -> tuple:
    none = pa.nulls(len(a), pa.int64())
    return none, np.minimum(a, b), np.maximum(a, b), pa.nulls(len(a), pa.int32())


def _across(shingle, name, n, place, root, bits):
    """Pairs of a heavy shingle whose nodes aren't in the same component, but for those that their
    bitmaps rule out."""
    order = np.lexsort((name, n, shingle))
    shingle, name, root, bits = shingle[order], name[order], root[order], bits[order]
    n, place = n[order].astype(np.int64), place[order].astype(np.int64)
    for x, y in zip(*_runs(shingle)):
        if (root[x:y] != root[x]).any():
            for a, b in _pairs_of(np.array([x]), np.array([y - x])):
                good = (root[a] != root[b]) & _possible(n, place, a, b)
                a, b = a[good], b[good]
                good = _alike(bits, n, a, b)
                yield np.minimum(name[a[good]], name[b[good]]), np.maximum(name[a[good]], name[b[good]])


def marks(keys: DataFrame, *names: str):
    """Whether a row may be among ``keys``: a bitmap of bounded size, for all executors. It
    spares other rows a shuffle; a join must decide on those that are left."""
    place = F.pmod(F.xxhash64(*names), F.lit(MARKS)).cast("int")
    bits = np.zeros(MARKS, bool)
    bits[keys.select(place.alias("m")).distinct().toArrow().column("m").to_numpy()] = True
    sent = keys.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf("boolean")
    def look(m: pa.Array) -> pa.Array:
        at = m.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return look(place)


def node_texts(nodes: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """``node, text``: one text of each of ``nodes``."""
    named = made.join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    named = write_once(named)
    some = docs.where(marks(named, "text_key")).join(named, "text_key")
    texts = write_once(some.groupBy("node").agg(F.first("text").alias("text")))
    forget(named)
    return texts


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def bitmaps(nodes: DataFrame, made: DataFrame) -> DataFrame:
    """``node, n, bits`` of ``nodes``."""
    some = made.where("bits IS NOT NULL").join(nodes.distinct(), "node", "left_semi")
    return write_once(some.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))


def alike(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that the bitmaps of ``signs`` (node, n, bits) leave open."""
    both = pairs.join(signs.toDF("a", "n", "x"), "a").join(signs.toDF("b", "m", "y"), "b")
    out = pairs.sparkSession.createDataFrame([], "a bigint, b bigint").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            bits = np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"])
            n = np.concatenate([batch.column(c).to_numpy() for c in "nm"]).astype(np.int64)
            good = pa.array(_alike(bits, n, np.arange(k), np.arange(k, 2 * k)))
            yield batch.select(["a", "b"]).filter(good)

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, out)


def similar(pairs: DataFrame, docs: DataFrame, made: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    pairs = write_once(pairs.distinct(), TEXT_ROWS)
    if pairs.isEmpty():
        return pairs
    texts = node_texts(_ends(pairs), docs, made)
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    num, den = LEAST

    def start():
        last: dict = {}

        def known(name: int, text: bytes) -> np.ndarray:
            if name not in last:
                if len(last) > 64:
                    last.clear()
                last[name] = shingles(text)
            return last[name]

        def work(batch: dict) -> dict:
            near = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
                x, y = known(a, x), known(b, y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common * (num + den) >= num * (len(x) + len(y)))
            return {"a": batch["a"], "b": batch["b"], "near": near}

        return work

    found = map_texts(both.select("a", "b", "x", "y"), "a bigint, b bigint, near boolean", start)
    links = write_once(found.where("near").select("a", "b"), TEXT_ROWS)
    forget(pairs)
    forget(texts)
    return links


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a, b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, known: DataFrame | None = None
) -> DataFrame:
    """``doc_id, text_key, component`` of every row: rows have the same component if a chain
    of sufficiently similar texts joins theirs. ``known`` (node, root): components of verified
    links that were found before; pairs within them need no verification."""
    made = write_once(keyed_sets(docs, id_col, text_col), TEXT_ROWS)
    posts = made.where("rare IS NOT NULL").select("node", "n", F.posexplode("rare").alias("place", "shingle"))
    met = write_once(_map(posts.select("shingle", "node", "n", "place"), MET, _meet(heavy)))
    pairs = met.where("place IS NULL").select("a", "b").distinct()
    pairs = write_once(pairs if known is None else apart(pairs, known))
    full = met.where("place IS NOT NULL").select("shingle", F.col("a").alias("node"), F.col("b").cast("int").alias("n"), "place")
    whole = docs.select(text_key(docs, text_col).alias("text_key"), docs[text_col].cast("binary").alias("text"))
    signs = bitmaps(_ends(pairs).union(full.select("node")), made)
    links = similar(alike(pairs, signs), whole, made)
    forget(pairs)
    if known is not None:
        links = links.union(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(links)
    if not full.isEmpty():
        rooted = full.join(roots, "node", "left").join(signs.select("node", "bits"), "node")
        rooted = rooted.select("shingle", "node", "n", "place", F.coalesce("root", "node").alias("root"), "bits")
        more = similar(_map(rooted, "a bigint, b bigint", _across), whole, made)
        if not more.isEmpty():
            roots = components(links.union(more))
    rows = write_once(made.select("doc_id", "text_key", "node"))
    for table in (made, met, signs):
        forget(table)
    return rows.join(roots, "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("component"))
