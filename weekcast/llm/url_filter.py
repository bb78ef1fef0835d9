"""2. URL filter: a trie over reversed host labels, then over path segments.

The rules form one trie, which every task gets; its size is that of the rule list, at most
``MOST_RULES``. A URL walks down its host labels from the right, and at each node down its
path segments; among the rules met, the longest wins, whether it allows or blocks.

A null URL, or one without ``://``, has an empty host and path and gets the default
verdict. Repeated rows give one row each, an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekcast.llm.common import fresh

MOST_RULES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, entry: str) -> Rule:
    """``rule("block", "example.com/de/")``."""
    host, slash, path = entry.partition("/")
    return Rule(verdict, host, slash + path)


# The rules of the contract.
RULES = (
    rule("block", "net/"),
    rule("allow", "example.net/en/"),
    rule("block", "example.com/de/"),
    rule("allow", "org/fr/"),
)


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    segments: dict[str, _Node] = field(default_factory=dict)
    #: Rules that end here, by the beginning of the next segment that they ask for.
    ends: dict[str, Rule] = field(default_factory=dict)
    #: The lengths of those beginnings, the longest first.
    sizes: list[int] = field(default_factory=list)


class Trie:
    def __init__(self, rules: Sequence[Rule]):
        self.root = _Node()
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, begun = r.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            known = node.ends.get(begun)
            if known is None or (known.verdict, r.verdict) == ("allow", "block"):
                node.ends[begun] = r  # of two equal entries the block stays
                if len(begun) not in node.sizes:
                    node.sizes = sorted([*node.sizes, len(begun)], reverse=True)

    def find(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        parts = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            below = node
            for segment in parts:
                # The longest beginning of the segment that is an entry; one lookup per length.
                for size in below.sizes:
                    r = below.ends.get(segment[:size]) if size <= len(segment) else None
                    if r is not None:
                        best = r if best is None or len(r.text) >= len(best.text) else best
                        break
                below = below.segments.get(segment)
                if below is None:
                    break
        return best


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added (under names with a
    leading underscore where ``pages`` already has such a column)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [shared.value.find(h, p) for h, p in zip(host, path)]
        return pd.DataFrame(
            {"rule": [r and r.text for r in found], "verdict": [r.verdict if r else default for r in found]},
            dtype=object,
        )

    url = F.coalesce(pages[url_col].cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, parts, 1), upper, lower)
    path = F.regexp_extract(url, parts, 2)
    out = pages.withColumn(h := fresh(pages, "host"), host)
    out = out.withColumn(p := fresh(out, "path"), path)
    out = out.withColumn(j := fresh(out, "judged"), judge(F.col(h), F.col(p)))
    out = out.withColumn(fresh(out, "rule"), F.col(f"{j}.rule"))
    return out.withColumn(fresh(out, "verdict"), F.col(f"{j}.verdict")).drop(j)
