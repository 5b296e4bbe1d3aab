"""The median slope of all pairs of points, without the pairs.

With the points in order of x, a pair's slope is at most t exactly if the pair stands in the wrong order by y - t x.  So the
slopes up to t are counted as inversions, by merging, in n log n steps for n points; a sample of pairs brackets the
wanted rank, the bracket is halved until it holds few pairs, and only these are listed, as the inversions between the orders at
both ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LISTED = 1 << 21  # pairs that may be listed
SAMPLED = 1 << 17


def _halves(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of a merge sort of distinct numbers below their count: (sorted left halves, right halves, how many of its left half each right
    value is below), a row a block."""
    size = 1 << max(1, (len(values) - 1).bit_length())
    held = np.concatenate((values, np.arange(len(values), size)))
    width = 1
    while width < size:
        blocks = held.reshape(-1, 2 * width)
        left, right = blocks[:, :width], blocks[:, width:]
        shift = np.arange(len(blocks))[:, None] * size
        place = np.searchsorted((left + shift).ravel(), (right + shift).ravel()).reshape(right.shape)
        yield left, right, width - (place - np.arange(len(blocks))[:, None] * width)
        held = np.sort(blocks, axis=1).ravel()
        width *= 2


class Slopes:
    """The slopes of all pairs of finite points with different x, ranked from 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.lexsort((y, x))
        self.x, self.y = x[order].astype(float), y[order].astype(float)
        _, group, sizes = np.unique(self.x, return_inverse=True, return_counts=True)
        points = len(x)
        self.total = (points * (points - 1) - int((sizes * (sizes - 1)).sum())) // 2
        # of points level at a slope those of larger x come first, so that a pair of just that slope counts
        self._tie = -group.astype(np.int64) * points + np.arange(points)
        steps = np.diff(np.unique(self.x))
        self.steepest = float(np.ptp(self.y) / steps.min()) * 2 + 1 if len(steps) else 0.0
        self._counts: dict[float, int] = {}
        self._tight: set[float] = set()

    def _ranks(self, slope: float) -> np.ndarray:
        if np.isinf(slope):
            tilted = -self.x if slope > 0 else self.x
            order = np.lexsort((np.arange(len(self.x)), tilted))
        else:
            order = np.lexsort((self._tie, self.y - slope * self.x))
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return ranks

    def up_to(self, slope: float) -> int:
        """How many slopes are at most this."""
        if np.isinf(slope):
            return self.total if slope > 0 else 0
        if slope not in self._counts:
            self._counts[slope] = sum(int(fewer.sum()) for _, _, fewer in _halves(self._ranks(slope)))
        return self._counts[slope]

    def between(self, low: float, high: float) -> np.ndarray:
        """The slopes above ``low`` and up to ``high``, sorted."""
        first, last = self._ranks(low), self._ranks(high)
        order, back = np.argsort(first), np.argsort(last)
        found = []
        for left, right, fewer in _halves(last[order]):
            row, column = np.nonzero(fewer)
            times = fewer[row, column]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            one = back[left[np.repeat(row, times), left.shape[1] - 1 - step]]
            other = back[np.repeat(right[row, column], times)]
            found.append(self._slopes(one, other))
        return np.sort(np.concatenate(found))

    def _slopes(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        near, far = np.minimum(one, other), np.maximum(one, other)
        return (self.y[far] - self.y[near]) / (self.x[far] - self.x[near])

    def _sample(self) -> np.ndarray:
        draw = np.random.default_rng(len(self.x))
        one, other = draw.integers(0, len(self.x), (2, SAMPLED))
        different = self.x[one] != self.x[other]
        return np.sort(self._slopes(one[different], other[different]))

    def ranked(self, rank: int, sample: np.ndarray) -> float:
        """The slope of a rank.  Between neighbouring doubles the upper one stands for all slopes."""
        low, high = -np.inf, np.inf
        at = rank / self.total * len(sample)
        for spread in (4, 40):
            reach = spread * np.sqrt(len(sample)) / 2
            for place in (at - reach, at + reach):
                if 0 <= place < len(sample) and low < sample[int(place)] < high:
                    slope = float(sample[int(place)])
                    low, high = (low, slope) if self.up_to(slope) >= rank else (slope, high)
        while self.up_to(high) - self.up_to(low) > LISTED:
            inside = sample[np.searchsorted(sample, low, "right") : np.searchsorted(sample, high, "left")]
            if len(inside):
                middle = float(inside[len(inside) // 2])
            elif high not in self._tight and np.isfinite(high):
                self._tight.add(high)  # many pairs on one line have the very slope that bounds them
                middle = float(np.nextafter(high, -np.inf))
                self._tight.add(middle)
            else:
                middle = _middle(max(low, -self.steepest), min(high, self.steepest))
            if not low < middle < high:
                return high
            if self.up_to(middle) >= rank:
                high = middle
            elif middle == np.nextafter(high, -np.inf):
                return high
            else:
                low = middle
        return float(self.between(low, high)[rank - self.up_to(low) - 1])


def _middle(low: float, high: float) -> float:
    """The double half way between two in their order, so that no bisection takes more than 64 turns."""
    bits = np.array([low, high]).view(np.int64)
    places = [int(b) if b >= 0 else -(int(b) & 0x7FFFFFFFFFFFFFFF) for b in bits]
    middle = (places[0] + places[1]) // 2
    return float(np.array([middle if middle >= 0 else -middle - 2**63], np.int64).view(np.float64)[0])


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """Mean of the lower and the upper median of the slopes; None if no two points differ in x."""
    slopes = Slopes(x, y)
    if not slopes.total:
        return None
    if slopes.total <= LISTED:
        every = slopes.between(-np.inf, np.inf)
        return float((every[(slopes.total - 1) // 2] + every[slopes.total // 2]) / 2)
    sample = slopes._sample()
    lower, upper = (slopes.ranked(r, sample) for r in ((slopes.total + 1) // 2, slopes.total // 2 + 1))
    return (lower + upper) / 2
