"""Vectorised connected components inside one task."""

from __future__ import annotations

import numpy as np


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b; each label is the smallest index of its component so far."""
    while a.size:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            hop = labels[labels]
            if np.array_equal(hop, labels):
                break
            labels = hop
    return labels


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links a-b of a forest that spans every component of the rows 0 to n - 1."""
    labels, place, picked = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while True:
        la, lb = labels[a[place]], labels[b[place]]
        differ = la != lb
        place, la, lb = place[differ], la[differ], lb[differ]
        if not place.size:
            return np.concatenate(picked)
        # the first link out of each component: links are ordered, so the picked ones close no ring
        first = np.full(n, len(a))
        np.minimum.at(first, la, place)
        np.minimum.at(first, lb, place)
        new = np.unique(first[first < len(a)])
        picked.append(new)
        labels = merge_labels(labels, a[new], b[new])
