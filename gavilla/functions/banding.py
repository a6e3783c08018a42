"""Choice of bands and rows for a Jaccard threshold."""

from __future__ import annotations

import numpy as np


def choose_bands(threshold: float, num_perm: int, steps: int = 1000) -> tuple[int, int]:
    """(bands, rows) with bands * rows <= num_perm and the least false positive + false negative area.

    The chance of sharing a band at similarity s is 1 - (1 - s^rows)^bands; the false positive area is
    its integral below the threshold and the false negative area that of its complement above it.
    """
    below = (np.arange(steps) + 0.5) * threshold / steps
    above = threshold + (np.arange(steps) + 0.5) * (1 - threshold) / steps
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            false_pos = np.mean(1 - (1 - below**rows) ** bands) * threshold
            false_neg = np.mean((1 - above**rows) ** bands) * (1 - threshold)
            area = 0.5 * false_pos + 0.5 * false_neg
            if best is None or area < best[0]:
                best = (area, bands, rows)
    return best[1], best[2]
