"""Components: of link tables (from the library) and of a block in memory."""

from __future__ import annotations

import numpy as np

from panweave.operators.graph import components  # noqa: F401


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over links a-b (a block in memory)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    while True:
        nxt = label[label]
        if np.array_equal(nxt, label):
            return label
        label = nxt
