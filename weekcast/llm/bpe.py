"""9. Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The text is cut at the special tokens, then into pre-tokens by the vocabulary's pattern.
Within a pre-token the tree's root names the leftmost pair of lowest rank; a merge changes
three leaves, each in logarithmic time, so a pre-token of any length takes O(n log n).
Frequent pre-tokens are remembered per task in a table of bounded size.

Nulls are encoded as the empty text (no ids, empty decoded text). Repeated keys and texts
give one row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from weekcast.llm.common import Remembered, held_model, keyed_texts, map_texts

FILE = "byte_bpe_50k.json"
_NONE = 1 << 62
#: Trees of up to so many leaves are rows of one array.
_WIDEST = 128
#: Pre-tokens and parts that a worker remembers, and those of a task that shares its executor with
#: large shuffles; an entry takes some 200 bytes.
REMEMBERED, FEW = (400_000, 400_000), (100_000, 50_000)
_MORE_THAN_A_SPACE = re.compile(r"\A |\s | \s| \Z")


def tokenizer_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class PairTree:
    """Minimum of (rank, position) over the adjacent pairs of one symbol sequence."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [_NONE] * self.size + keys + [_NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node, i = self.node, self.size + at
        node[i] = key
        while i > 1:
            i >>= 1
            left, right = node[2 * i], node[2 * i + 1]
            low = left if left < right else right
            if node[i] == low:
                break
            node[i] = low


class Bpe:
    """A byte-level BPE file of the tokenizers format, without normaliser."""

    def __init__(self, path: str, known: int, parts: int):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 32 | vocab[b], n)
            self.made.append(vocab[a + b])
        self.raw = {i: bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode() for word, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw |= {i: word.encode() for word, i in self.special.items()}
        self.pattern = regex.compile(_pattern())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        order = sorted(self.rank)
        self.pairs = np.array(order, np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in order], np.int64)
        self.made_ids, self.byte_ids = np.array(self.made, np.int64), np.array(self.byte_id, np.int64)
        self.known, self.parts, self.cuts = Remembered(known), Remembered(parts), Remembered(parts)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return self.pattern.findall(text)

    def measured(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Of each text its parts between spaces, and per pre-token the number of characters
        and of ids. Parts are cut into pre-tokens and measured once, and remembered."""
        parts = [_between_spaces(t) for t in texts]
        table = self.cuts.lookup(set().union(*parts), self._measure)
        return [(x, np.frombuffer(b"".join(map(table.__getitem__, x)), np.uint32).reshape(-1, 2)) for x in parts]

    def _measure(self, parts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(p) for p in parts]
        ids = self.known.lookup(set().union(*cut), self.merge_many)
        return [array("I", [n for p in x for n in (len(p), len(ids[p]) >> 2)]).tobytes() for x in cut]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.rank, self.made

        def key(left: int, right: int) -> int:
            r = rank.get(ids[left] << 32 | ids[right])
            return _NONE if r is None else r << 32 | left

        tree = PairTree([key(i, i + 1) for i in range(n - 1)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree.root()) != _NONE:
            at = best & 0xFFFFFFFF
            gone = after[at]
            ids[at] = made[best >> 32]
            ids[gone] = -1
            nxt = after[gone]
            after[at] = nxt
            if gone < n - 1:
                tree.put(gone, _NONE)
            if nxt < n:
                before[nxt] = at
                tree.put(at, key(at, nxt))
            else:
                tree.put(at, _NONE)
            if before[at] >= 0:
                tree.put(before[at], key(before[at], at))
        return [i for i in ids if i >= 0]

    def merge_many(self, pieces: list[str]) -> list[bytes]:
        """Ids of many pre-tokens: their trees are rows of one array, and the point updates
        of all rows run together. Long ones have a tree of their own."""
        data = [p.encode("utf-8") for p in pieces]
        out = [b""] * len(data)
        widths: dict[int, list[int]] = {}
        for i, d in enumerate(data):
            width = 1 << max(1, len(d) - 1).bit_length()
            if width > _WIDEST:
                out[i] = array("I", self.merge(d)).tobytes()
            elif d:
                widths.setdefault(width, []).append(i)
        for width, rows in widths.items():
            step = (1 << 18) // width
            for k in range(0, len(rows), step):
                block = rows[k : k + step]
                for i, ids in zip(block, self._merge_block([data[i] for i in block], width)):
                    out[i] = ids
        return out

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[slot] == pair, self.pair_ranks[slot] << 16 | at, _NONE)

    def _merge_block(self, data: list[bytes], width: int) -> list[bytes]:
        n = np.array([len(d) for d in data])
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(-1, width)
        place = np.arange(width)
        ids = np.where(place < n[:, None], self.byte_ids[raw], -1)
        tree = np.full((len(data), 2 * width), _NONE)
        leaves = self._keys(ids[:, :-1], ids[:, 1:], place[:-1])
        tree[:, width : 2 * width - 1] = np.where(place[1:] < n[:, None], leaves, _NONE)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        after, before = np.tile(place + 1, (len(data), 1)), np.tile(place - 1, (len(data), 1))

        def put(rows: np.ndarray, at: np.ndarray, keys: np.ndarray | int) -> None:
            node = at + width
            tree[rows, node] = keys
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(len(data))
        while len(rows := rows[tree[rows, 1] != _NONE]):
            best = tree[rows, 1]
            at = best & 0xFFFF
            gone = after[rows, at]
            new = self.made_ids[best >> 16]
            ids[rows, at], ids[rows, gone] = new, -1
            nxt = after[rows, gone]
            after[rows, at] = nxt
            put(rows, gone, _NONE)
            more = nxt < n[rows]
            right = np.where(more, nxt, 0)
            before[rows[more], right[more]] = at[more]
            put(rows, at, np.where(more, self._keys(new, ids[rows, right], at), _NONE))
            prev = before[rows, at]
            some = prev >= 0
            r, q = rows[some], prev[some]
            put(r, q, self._keys(ids[r, q], new[some], q))
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _pieces_to_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens, by pre-token."""
        cut = [self.pattern.findall(p) for p in parts]
        ids = self.known.lookup(set().union(*cut), self.merge_many)
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space always starts a pre-token,
        so what lies between such spaces is encoded, and remembered, on its own."""
        runs: list[list] = []
        for text in texts:
            special = self.cut and any(word in text for word in self.special)
            runs.append(self.cut.split(text) if special else [text])
        plain = [part for run in runs for part in run if part not in self.special]
        cut = [_between_spaces(part) for part in plain]
        ids = self.parts.lookup(set().union(*cut), self._pieces_to_ids)
        done = iter([b"".join(map(ids.__getitem__, x)) for x in cut])
        return [
            b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else next(done) for p in run)
            for run in runs
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """Bytes that are no UTF-8 become U+FFFD, as the library does."""
        return b"".join(map(self.raw.__getitem__, array("I", ids))).decode("utf-8", "replace")


def _between_spaces(text: str) -> list[str]:
    """The text cut before each space that stands alone between other characters; every
    part but the first begins with its space. Joined, the parts are the text."""
    first, *rest = text.split(" ")
    if not _MORE_THAN_A_SPACE.search(text):
        return [first, *(" " + part for part in rest)]
    parts = [first]
    for part in rest:
        if parts[-1] and part and not parts[-1][-1].isspace() and not part[0].isspace():
            parts.append(" " + part)
        else:
            parts[-1] = f"{parts[-1]} {part}"
    return parts


def _pattern() -> str:
    # Fixed value: the split pattern of byte-level vocabularies of this family.
    return (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
        r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
    )


def load(path: str) -> Bpe:
    """One per Python worker: tasks of the same worker share it."""
    return held_model(("bpe", path), lambda: Bpe(path, *REMEMBERED))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers) and ``decoded``, no shuffle."""

    def start():
        bpe = load(path or tokenizer_path())

        def work(batch: dict) -> dict:
            ids = bpe.encode_many([t or "" for t in batch["text"]])
            return {"doc_id": batch["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

        return work

    key = dict(keyed_texts(docs, id_col, text_col).dtypes)["doc_id"]
    return map_texts(keyed_texts(docs, id_col, text_col), f"doc_id {key}, ids binary, decoded string", start)


def digests(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", brief: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the digest is taken where the ids
    are made, so ids and texts don't leave the task. ``brief``: the model remembers ``FEW``
    and ends with its task, which takes less memory and more time; the rows are the same."""

    def start():
        bpe = Bpe(path or tokenizer_path(), *FEW) if brief else load(path or tokenizer_path())

        def work(batch: dict) -> dict:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in bpe.encode_many([t or "" for t in batch["text"]]):
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            return out

        return work

    texts = keyed_texts(docs, id_col, text_col)
    return map_texts(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start, 2 << 20 if brief else 4 << 20)
