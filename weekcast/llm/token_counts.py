"""1. Token counts that follow edits.

A document's pre-tokens are the leaves of a segment tree whose nodes sum the characters and
the tokens below them. An edit finds its leaves by descending over the character sums,
encodes again only the edited region with the context that can change how it is cut, puts
the new pre-tokens into the first leaf of the region, empties the others, and updates the
sums above. The count of the whole text is the root's.

Context: cutting at a pre-token's end looks at most ``AHEAD`` characters further, so it
starts again at the first pre-token that ends within that reach of the edit; and as cutting
never looks back, it stops at the first cut after the edit that was one before.

A null text is the empty text; null edits are none. Edits are (start, end, replacement) in
code points of the text they find, applied in the order given; places outside the text are
moved to its ends, and a null replacement is empty. Repeated documents give one row each and
an empty table gives an empty one.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.bpe import Bpe, load, tokenizer_path
from weekcast.llm.common import keyed_texts, map_texts

AHEAD = 3
EDIT = "array<struct<first:bigint,end:bigint,replacement:string>>"


class CountTree:
    """``parts``: the text in parts that end where pre-tokens end; ``sizes``: characters and
    tokens of each pre-token, one leaf each. ``changed``: the pre-tokens of the leaves that
    edits have touched. ``chars`` and ``tokens`` hold the sums of all nodes, root at 1."""

    def __init__(self, bpe: Bpe, parts: list[str], sizes: np.ndarray):
        self.bpe = bpe
        self.parts = parts
        self.leaves = len(sizes)
        self.changed: dict[int, list[str]] = {}
        self.size = 1 << max(0, self.leaves - 1).bit_length()
        self.chars = self._sums(sizes[:, 0])
        self.tokens = self._sums(sizes[:, 1])
        self.encoded = 0

    @classmethod
    def of(cls, bpe: Bpe, text: str) -> CountTree:
        return cls(bpe, *bpe.measured([text])[0])

    @cached_property
    def pieces(self) -> list[str]:
        """The pre-tokens of the first text; needed only where there are edits."""
        return [p for part in self.parts for p in self.bpe.pieces(part)]

    def _counts(self, pieces: list[str]) -> list[int]:
        ids = self.bpe.known.lookup(set(pieces), self.bpe.merge_many)
        return [len(x) >> 2 for x in map(ids.__getitem__, pieces)]

    def _sums(self, values: np.ndarray) -> np.ndarray:
        node = np.zeros(2 * self.size, np.int64)
        node[self.size : self.size + len(values)] = values
        at = self.size
        while at > 1:
            node[at // 2 : at] = node[at : 2 * at].reshape(-1, 2).sum(axis=1)
            at //= 2
        return node

    def _leaf(self, k: int) -> list[str]:
        if k in self.changed:
            return self.changed[k]
        return self.pieces[k : k + 1]

    def total(self) -> int:
        return int(self.tokens[1])

    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        if not self.changed:
            return "".join(self.parts)
        return "".join(p for k in range(max(1, self.leaves)) for p in self._leaf(k))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and the place of the leaf's first."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _put(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.changed[leaf] = pieces
        node = leaf + self.size
        more_chars = sum(map(len, pieces)) - self.chars[node]
        more_tokens = sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, first: int, end: int, replacement: str) -> None:
        length = self.length()
        first = min(max(first, 0), length)
        end = min(max(end, first), length)
        # Cut again from the start of the first pre-token that ends after this place.
        low, start = self._leaf_at(max(0, first - AHEAD)) if length else (0, 0)
        pieces, high = list(self._leaf(low)), low
        stop = start + sum(map(len, pieces))
        kept: list[str] = []
        while pieces and start + len(pieces[0]) <= first - AHEAD:
            kept.append(pieces[0])
            start += len(pieces.pop(0))
        while True:
            # Old cuts at or after the end of the edit, in places of the new text.
            moved = len(replacement) - (end - first)
            old, at = set(), start
            for p in pieces:
                if at >= end:
                    old.add(at + moved - start)
                at += len(p)
            if stop >= end and (stop == length or high + 1 >= self.leaves):
                old.add(stop + moved - start)
            region = "".join(pieces)
            whole = region[: max(0, first - start)] + replacement + region[max(0, end - start) :]
            sure = stop == length
            cut, at, n = self._cut(whole, old, sure)
            if cut is not None:
                break
            high += 1
            pieces += self._leaf(high)
            stop += sum(map(len, self._leaf(high)))
        # What follows the last new cut inside the region was cut there before.
        rest, place = [], start
        for p in pieces:
            if place + moved - start >= at and place >= end:
                rest.append(p)
            place += len(p)
        self.encoded += n
        new = kept + cut + rest
        self._put(low, new, self._counts(new))
        for leaf in range(low + 1, high + 1):
            self._put(leaf, [], [])

    def _cut(self, whole: str, old: set[int], sure: bool) -> tuple[list[str] | None, int, int]:
        """New pre-tokens up to a place where the text was cut before and whose cut can't
        depend on what lies beyond ``whole``; None if there is no such place yet."""
        made, at = [], 0
        for m in self.bpe.pattern.finditer(whole):
            if at in old:
                return made, at, at
            if not sure and m.end() + AHEAD > len(whole):
                return None, 0, 0
            made.append(m.group())
            at = m.end()
        return (made, at, at) if sure else (None, 0, 0)


def edited_counts(docs: DataFrame, edits_col: str = "edits", path: str | None = None, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_after, n_encoded_chars`` (characters encoded
    again) and, ``with_text``, ``edited`` (the text afterwards). No shuffle. The strings of
    special tokens count as ordinary text."""
    table = docs.select(*(docs[c].alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text"), (edits_col, "edits"))))

    def start():
        bpe = load(path or tokenizer_path())

        def work(batch: dict) -> dict:
            names = ("n_tokens", "n_edits", "n_tokens_after", "n_encoded_chars", "edited")
            out: dict[str, list] = {"doc_id": batch["doc_id"]} | {n: [] for n in names}
            measured = bpe.measured([t or "" for t in batch["text"]])
            for (parts, sizes), edits in zip(measured, batch["edits"]):
                tree = CountTree(bpe, parts, sizes)
                before = tree.total()
                for e in edits or []:
                    tree.edit(e["first"] or 0, e["end"] or 0, e["replacement"] or "")
                found = (before, len(edits or []), tree.total(), tree.encoded, tree.text() if with_text else None)
                for n, v in zip(names, found):
                    out[n].append(v)
            return out

        return work

    return map_texts(
        table,
        f"doc_id {dict(table.dtypes)['doc_id']}, n_tokens bigint, n_edits bigint, n_tokens_after bigint,"
        " n_encoded_chars bigint" + ", edited string" * with_text,
        start,
    )


# What the redaction looks for, and what takes its place.
EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.ASCII)
NUMBER = re.compile(r"\+?\d[\d\-. ()]{7,}\d", re.ASCII)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put a placeholder for every e-mail address and long number, from the last
    to the first, so that places stay those of the text given."""
    mails = [(m.start(), m.end(), "<EMAIL>") for m in EMAIL.finditer(text)] if "@" in text else []
    numbers = [(m.start(), m.end(), "<NUMBER>") for m in NUMBER.finditer(text)]
    apart = [x for x in numbers if all(x[1] <= a or b <= x[0] for a, b, _ in mails)]
    return sorted(mails + apart, reverse=True)


def with_redactions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edits`` with the redactions of every text as its edits."""
    texts = keyed_texts(docs, id_col, text_col)

    def start():
        def work(batch: dict) -> dict:
            found = [[dict(zip(("first", "end", "replacement"), e)) for e in redactions(t or "")] for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "text": batch["text"], "edits": found}

        return work

    return map_texts(texts, f"doc_id {dict(texts.dtypes)['doc_id']}, text string, edits {EDIT}", start)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, edits`` from a table ``edits`` (doc_id, seq, first, end, replacement),
    in order of ``seq``; all edits of one document meet in one row."""
    entry = F.struct("seq", "first", "end", "replacement")
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    listed = listed.select("doc_id", F.expr("transform(found, x -> struct(x.first, x.end, x.replacement))").cast(EDIT).alias("edits"))
    return keyed_texts(docs, id_col, text_col).join(listed, "doc_id", "left")
