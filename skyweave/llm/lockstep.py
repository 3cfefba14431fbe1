"""Many sequences advanced together, one place at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Lockstep:
    """Sequences of the given lengths, longest first, laid out place by place.

    ``order`` turns sequence-major rows into place-major rows; the rows of place
    ``t`` are ``bounds[t]:bounds[t + 1]``, in the order of the sequences, and
    those still running at ``t + 1`` are the first of them.
    """

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        if (np.diff(lengths) > 0).any():
            raise ValueError("longest first")
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        self.owner_major = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(total) - np.repeat(first, lengths)
        self.order = np.argsort(place, kind="stable")
        running = np.bincount(place, minlength=1) if total else np.zeros(0, np.int64)
        self.bounds = np.r_[0, np.cumsum(running)].astype(np.int64)
        self.owner = self.owner_major[self.order]
        self.place = place[self.order]

    def steps(self) -> Iterator[tuple[int, int]]:
        marks = self.bounds.tolist()
        return zip(marks, marks[1:])

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows with a predecessor, and the row of that predecessor."""
        later = np.arange(self.bounds[1] if len(self.bounds) > 1 else 0, len(self.order))
        return later, self.bounds[self.place[later] - 1] + self.owner[later]


def bounded_groups(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Positions of the non-empty sequences, longest first, in groups of about ``most`` items.

    A longer sequence is a group of its own.
    """
    order = np.argsort(-np.asarray(lengths), kind="stable")
    order = order[np.asarray(lengths)[order] > 0]
    sums = np.cumsum(np.asarray(lengths)[order])
    at = 0
    while at < len(order):
        base = sums[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sums, base + most, side="right")))
        yield order[at:end]
        at = end
