"""Arrow kernel of the pair metrics: packed tracks of many pairs at once as dense arrays of (pair, shared step).

Conflict times need the nearest step of one track to each step of the other. Both tracks are cut into cells of PIECE consecutive shared
steps with a bounding box; only cells whose boxes lie within the radius meet, and only their steps are compared. Everything is done for
CHUNK pair-steps at a time, so memory follows neither the pairs of a batch nor the square of a track.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lanewise.schema import EPS

#: Shared steps in a cell, pair-steps taken at once, and distances computed at once.
PIECE, CHUNK, PAIRS = 16, 1 << 17, 1 << 20
FIELDS = ("x", "y", "z", "v", "h", "len")
METRICS = ("_min_xy", "_min_sep", "_vi", "_vj", "separation", "intersection", "collision", "thw", "ttc", "drac", "mttcp")
COUNTS = ("n_shared", "n_aligned")

Track = dict[str, np.ndarray]


def _side(column: pa.ListArray, width: int) -> tuple[Track, np.ndarray]:
    """Fields of packed tracks as (track, step) arrays, and which steps are there; a null track has none."""
    begin, end = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    values, at = column.values, np.arange(width)
    index = np.minimum(begin[:, None] + at, max(0, len(values) - 1))
    there = (at < (end - begin)[:, None]) & column.is_valid().to_numpy(zero_copy_only=False)[:, None]
    if not len(values):
        return {f: np.zeros(index.shape) for f in FIELDS}, there & False
    there &= values.is_valid().to_numpy(zero_copy_only=False)[index]
    return {f: values.field(f).to_numpy(zero_copy_only=False).astype(np.float64)[index] for f in FIELDS}, there


def shared_tracks(left: pa.ListArray, right: pa.ListArray) -> tuple[Track, Track, np.ndarray]:
    """Both tracks at the steps where both are valid, in time order and from the left, and how many there are."""
    size = [np.diff(c.offsets.to_numpy()) for c in (left, right)]
    width = int(np.minimum(*size).max(initial=0))
    (a, here), (b, there) = _side(left, width), _side(right, width)
    both = here & there
    n = both.sum(1)
    order = np.argsort(~both, axis=1, kind="stable")[:, :int(n.max(initial=0))]
    return *({f: np.take_along_axis(x, order, 1) for f, x in side.items()} for side in (a, b)), n


def _above(x: np.ndarray, limit) -> np.ndarray:
    """Greater, a NaN being greater than anything."""
    return (x > limit) | np.isnan(x)


def _wrap(delta: np.ndarray) -> np.ndarray:
    return np.mod(delta + 540.0, 360.0) - 180.0


def touch(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Do the closed segments AB and CD share a point? With overlapping boxes they do unless one lies strictly beside the other's line."""
    lo, hi = np.minimum, np.maximum
    boxes = (lo(ax, bx) <= hi(cx, dx)) & (lo(cx, dx) <= hi(ax, bx)) & (lo(ay, by) <= hi(cy, dy)) & (lo(cy, dy) <= hi(ay, by))

    def beside(ox, oy, px, py, *points):
        s, t = ((px - ox) * (y - oy) - (py - oy) * (x - ox) for x, y in points)
        return ((s > 0) & (t > 0)) | ((s < 0) & (t < 0))

    return boxes & ~beside(ax, ay, bx, by, (cx, cy), (dx, dy)) & ~beside(cx, cy, dx, dy, (ax, ay), (bx, by))


def _square(dx, dy, dz):
    return dx * dx + dy * dy + dz * dz


def nearest_steps(a: Track, b: Track, n: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, step of a, nearest step of b) of every step of a that b passes within the radius; of equally near steps the first."""
    pairs, width = a["x"].shape
    cells = -(-width // PIECE)
    at = np.arange(cells * PIECE).reshape(cells, PIECE)
    real = at[None] < n[:, None, None]
    step = np.minimum(at, max(0, width - 1))
    cut = [{c: t[c][:, step] for c in "xyz"} for t in (a, b)]
    box = [{(c, f): fn(np.where(real, t[c], pad), axis=2) for c in "xy" for f, fn, pad in (("low", np.nanmin, np.inf), ("high", np.nanmax, -np.inf))} for t in cut]
    gap = [np.maximum(0, np.maximum(box[0][c, "low"][:, :, None] - box[1][c, "high"][:, None], box[1][c, "low"][:, None] - box[0][c, "high"][:, :, None])) for c in "xy"]
    # Infinite boxes of empty cells and NaN gaps fail the comparison.
    with np.errstate(invalid="ignore"):
        which, p, q = np.nonzero(gap[0] ** 2 + gap[1] ** 2 <= (radius ** 2 * (1 + 1e-9))[:, None, None])
    found = []
    for s in range(0, len(which), PAIRS // PIECE**2):
        w, u, v = which[s:s + PAIRS // PIECE**2], p[s:s + PAIRS // PIECE**2], q[s:s + PAIRS // PIECE**2]
        d = _square(*(cut[0][c][w, u][:, :, None] - cut[1][c][w, v][:, None] for c in "xyz"))
        d = np.where(real[w, u][:, :, None] & real[w, v][:, None] & ~np.isnan(d), d, np.inf)
        best = d.argmin(2)
        low = np.take_along_axis(d, best[:, :, None], 2)[:, :, 0]
        row, k = np.nonzero(low <= (radius ** 2)[w][:, None])
        found.append((w[row], at[u[row], k], at[v[row], best[row, k]], low[row, k]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    w, k, other, low = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((other, low, k, w))
    w, k, other = w[order], k[order], other[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
    return w[first], k[first], other[first]


def conflict_times(a: Track, b: Track, n: np.ndarray, radius: np.ndarray, critical: bool) -> np.ndarray:
    """Per pair the least (mean) over its conflict points of the smallest time difference to it before the first agent is there; else infinite.

    Conflict points are positions of a that b passes within the radius at any shared step.
    """
    w, k, other = nearest_steps(a, b, n, radius)
    times = np.zeros(len(w))
    width = a["x"].shape[1]
    size = max(1, PAIRS // max(1, width))
    for s in range(0, len(w), size):
        pair, own = w[s:s + size], k[s:s + size]
        point = [a[c][pair, own][:, None] for c in "xyz"]
        to = [np.sqrt(_square(*(t[c][pair] - p for c, p in zip("xyz", point, strict=True)))) / t["v"][pair] for t in (a, b)]
        until = np.arange(width) <= np.minimum(own, other[s:s + size])[:, None]
        times[s:s + size] = np.fmin.reduce(np.where(until, np.abs(to[0] - to[1]), np.inf), axis=1)
    out = np.full(len(n), np.inf)
    if critical:
        np.fmin.at(out, w, times)
        return out
    hits = np.bincount(w, minlength=len(n))
    return np.where(hits > 0, np.bincount(w, times, len(n)) / np.maximum(hits, 1), np.inf)


def _least(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Row minimum of the masked entries, a NaN being greater than anything; NaN for rows without any."""
    low = np.where(mask & ~np.isnan(x), x, np.inf).min(1, initial=np.inf)
    return np.where((mask & ~np.isnan(x)).any(1), low, np.nan)


def _greatest(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask.any(1), np.where(mask, x, -np.inf).max(1, initial=-np.inf), np.nan)


def _mean(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    n = mask.sum(1)
    return np.where(n > 0, np.where(mask, x, 0.0).sum(1) / np.maximum(n, 1), np.nan)


def measure(left: pa.ListArray, right: pa.ListArray, limit: Track, critical: bool) -> Track:
    """The METRICS and COUNTS of pairs of packed tracks; `limit` has an array per threshold. A metric without any step is NaN."""
    a, b, n = shared_tracks(left, right)
    width = a["x"].shape[1]
    at = np.arange(width)
    mask = at < n[:, None]
    dx, dy, dz = (a[c] - b[c] for c in "xyz")
    xy, sep = np.sqrt(dx * dx + dy * dy), np.sqrt(_square(dx, dy, dz))
    aligned = mask & (np.abs(_wrap(b["h"] - a["h"])) <= limit["heading_threshold"][:, None])
    leads = _above(np.abs(_wrap(np.degrees(np.arctan2(b["y"] - a["y"], b["x"] - a["x"])) - a["h"])), 90.0)
    gap = sep - np.where(leads, a["len"], b["len"])
    follower = np.where(leads, b["v"], a["v"])
    closing = np.where(leads, b["v"] - a["v"], a["v"] - b["v"])
    nearing = _above(closing, 0.0)
    thw = np.abs(gap / (follower + EPS))
    ttc = np.where(nearing, np.abs(gap / np.where(nearing, closing + EPS, 1.0)), np.inf)
    drac = np.fmin(np.maximum(np.where(nearing, closing * closing / (2.0 * np.abs(gap) + EPS), 0.0), 0.0), limit["agent_max_deceleration"][:, None])
    # The first step reports the first segment, so it starts from the same two points as the second.
    prev, nxt = np.maximum(at - 1, 0), np.where(at == 0, min(1, max(width - 1, 0)), at)
    hit = mask & (n[:, None] > 1) & touch(*(t[c][:, i] for t in (a, b) for i in (prev, nxt) for c in "xy"))
    crash = hit | (mask & (sep <= limit["agent_to_agent_distance_breach"][:, None]))
    low = _least if critical else _mean
    tally = (lambda x: x.sum(1).astype(np.float64)) if critical else (lambda x: _mean(x.astype(np.float64), mask))
    return {
        "n_shared": n, "n_aligned": aligned.sum(1), "_min_xy": _least(xy, mask), "_min_sep": _least(sep, mask), "_vi": _mean(a["v"], mask),
        "_vj": _mean(b["v"], mask), "separation": low(sep, mask), "intersection": tally(hit), "collision": tally(crash),
        "thw": low(thw, aligned), "ttc": low(ttc, aligned), "drac": (_greatest if critical else _mean)(drac, aligned),
        "mttcp": conflict_times(a, b, n, limit["agent_to_conflict_point_max_distance"], critical)}


def metrics_task(kept: list[str], limits: dict[str, str], critical: bool):
    """Task over rows with steps_i, steps_j, the columns `kept` and a column per threshold: the kept ones and the metrics."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            longest = max(1, int(np.diff(batch.column("steps_i").offsets.to_numpy()).max()))
            size = max(1, CHUNK // longest)
            for s in range(0, batch.num_rows, size):
                rows = batch.slice(s, size)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    got = measure(rows.column("steps_i"), rows.column("steps_j"),
                                  {n: rows.column(c).to_numpy(zero_copy_only=False) for n, c in limits.items()}, critical)
                yield pa.record_batch([*(rows.column(c) for c in kept), *(pa.array(got[c].astype(np.int64)) for c in COUNTS),
                                       *(pa.array(got[c]) for c in METRICS)], names=[*kept, *COUNTS, *METRICS])

    return task
