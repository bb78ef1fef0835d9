"""Links within a task, joined in memory and handed on as a spanning forest."""

from __future__ import annotations

import numpy as np


class Forest:
    """Links among the documents of one task; each document's smallest one reachable."""

    def __init__(self, docs: np.ndarray):
        self.docs, self.at = np.unique(docs, return_inverse=True)
        self.root = np.arange(len(self.docs))

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows (positions in the input) that are linked."""
        a, b = self.at[a], self.at[b]
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.docs[moved], self.docs[self.root[moved]]
