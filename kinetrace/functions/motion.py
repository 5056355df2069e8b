"""Numeric kernels of motion traces: thinning, resampling, fingerprints and their distance."""

from __future__ import annotations

import numpy as np

#: Fixed values of the fingerprint contract.
TRACE_POINTS, SHAPE_POINTS, EPSILON = 240, 32, 1e-9
WEIGHTS = {"shape": 0.5, "dynamics": 0.35, "temporal": 0.15}


def thin(sizes: list[int], cap: int = TRACE_POINTS) -> dict[int, np.ndarray]:
    """Positions to keep in each run, so that all runs have `cap` points at most.

    The longest run shrinks by one until the total fits or every run has two; then the longest runs stay.
    Points are evenly spaced, with half-even rounding.
    """
    keep = np.array(sizes, np.int64)
    while keep.sum() > cap and keep.max() > 2:
        top = int(keep.max())
        second = int(max([2, *keep[keep < top]]))
        tall = np.flatnonzero(keep == top)
        need = int(keep.sum()) - cap
        level = max(second, top - -(-need // len(tall)), 2)
        if level < top and (top - level) * len(tall) <= need:
            keep[tall] = level
        else:  # the last step lowers the first ones only
            keep[tall] = level + 1 if top - level > 1 else top
            keep[tall[: int(keep.sum()) - cap]] -= 1
    chosen = range(len(sizes))
    if keep.sum() > cap:
        chosen, total = [], 0
        for i in np.lexsort((np.arange(len(sizes)), np.array(sizes)))[::-1].tolist():
            if total + keep[i] <= cap:
                chosen.append(i)
                total += keep[i]
    out = {}
    for i in sorted(chosen):
        n, k = sizes[i], int(keep[i])
        out[i] = np.arange(n) if k >= n else np.array([0, n - 1]) if k <= 2 else np.rint(np.arange(k) * ((n - 1) / (k - 1))).astype(np.int64)
    return out


def shape(times: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """A trace on SHAPE_POINTS even points of its span, divided by its mean size; empty where that is 0."""
    good = np.isfinite(times) & np.isfinite(scores)
    times, scores = times[good], scores[good]
    order = np.lexsort((scores, times))
    t, v = times[order], scores[order]
    if len(t) < 2 or t[-1] - t[0] <= EPSILON:
        return np.zeros(0)
    at = t[0] + (t[-1] - t[0]) * np.arange(SHAPE_POINTS) / (SHAPE_POINTS - 1)
    right = np.searchsorted(t, at, side="right")
    hi, lo = np.minimum(right, len(t) - 1), np.maximum(right - 1, 0)
    width = t[hi] - t[lo]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(right >= len(t), v[-1], np.where(width <= EPSILON, v[hi], v[lo] + (v[hi] - v[lo]) * ((at - t[lo]) / width)))
    size = np.abs(out).mean()
    return out / size if size > EPSILON else np.zeros(0)


def distance(a: dict, b: dict) -> tuple[float, str] | None:
    """(weighted mean of the parts that both have, the part that weighs most), or None without shape or dynamics."""
    parts = {}
    if len(a["shape"]) and len(b["shape"]):
        parts["shape"] = float(np.abs(np.asarray(a["shape"]) - np.asarray(b["shape"])).mean())
    both = a["dynamics"].keys() & b["dynamics"].keys()
    if both:
        parts["dynamics"] = sum((abs(a["dynamics"][k][0] - b["dynamics"][k][0]) + abs(a["dynamics"][k][1] - b["dynamics"][k][1])) / 2 for k in sorted(both)) / len(both)
    if not parts:
        return None
    parts["temporal"] = (abs(a["stall"] - b["stall"]) + abs(a["gap"] - b["gap"])) / 2
    total = sum(WEIGHTS[k] for k in parts)
    return sum(WEIGHTS[k] * v for k, v in parts.items()) / total, max(parts, key=lambda k: WEIGHTS[k] * parts[k])


#: Fixed value: a sample window holds at most twice so many values.
SAMPLE = 512


def sampled(n: int, half: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The positions, of n values in order, that a decimating window and its clock keep.

    Whenever the window is over full every second value goes, and the older half of the clock; later values come at full
    rate, so that after the first time the two are no longer of the same positions.
    """
    values = clock = np.zeros(0, np.int64)
    at = 0
    while at < n:
        room = 2 * half + 1 - len(values)
        new = np.arange(at, min(n, at + room))
        values, clock = np.append(values, new), np.append(clock, new)
        at += len(new)
        if len(values) > 2 * half:
            values = values[::2]
        while len(clock) > 2 * half:
            clock = clock[len(clock) - (len(clock) + 1) // 2 :]
    return values, clock


def evenly(n: int, most: int = 2 * SAMPLE) -> np.ndarray:
    """At most `most` evenly spaced positions of n, the same for values and clock."""
    return np.unique(np.linspace(0, n - 1, min(n, most)).round().astype(np.int64)) if n else np.zeros(0, np.int64)
