"""The peak kernel against a slow loop, and edge cases."""

import numpy as np
import pytest

from echograin.operators import peaks as P

KEYS = ["frame_id", "x", "y"]


def slow_peaks(h, height=None, distance=None, prominence=None, width=None):
    found, n, i = [], len(h), 1
    while i < n - 1:
        if h[i - 1] < h[i]:
            j = i
            while j < n - 1 and h[j + 1] == h[i]:
                j += 1
            if j < n - 1 and h[j + 1] < h[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if height is None or h[p] >= height]
    if distance is not None:
        for p in sorted(found, key=lambda p: (-h[p], p)):
            if p in found:
                found = [q for q in found if q == p or abs(q - p) >= np.ceil(distance)]
    out = []
    for p in found:
        lo = hi = lb = rb = p
        while lo >= 0 and h[lo] <= h[p]:
            if h[lo] < h[lb]:
                lb = lo
            lo -= 1
        while hi < n and h[hi] <= h[p]:
            if h[hi] < h[rb]:
                rb = hi
            hi += 1
        prom = h[p] - max(h[lb], h[rb])
        if prominence is not None and prom < prominence:
            continue
        level = h[p] - prom * 0.5
        i = p
        while i > lb and level < h[i]:
            i -= 1
        left = i + ((level - h[i]) / (h[i + 1] - h[i]) if h[i] < level else 0)
        i = p
        while i < rb and level < h[i]:
            i += 1
        right = i - ((level - h[i]) / (h[i - 1] - h[i]) if h[i] < level else 0)
        if width is None or right - left >= width:
            out.append((p, float(h[p]), float(prom), round(float(right - left), 9)))
    return out


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(7)
    some = [rng.integers(0, top, n) for top in (2, 4, 30) for n in (3, 10, 64, 200) for _ in range(15)]
    return [*some, np.zeros(20, int), np.full(20, 5), np.array([5, 5, 1, 2, 2, 1, 7, 7]), np.array([1]), np.array([], int), np.array([0, 9, 9, 9, 0]), np.arange(30)]


@pytest.mark.parametrize("options", [{}, {"height": 2}, {"height": 1, "distance": 4.5}, {"prominence": 2}, {"width": 1.5}, {"height": 1, "distance": 3, "prominence": 2, "width": 1}])
def test_kernel_equals_loop(spark, waves, options):
    rows = spark.createDataFrame([(k, 0, 0, [int(v) for v in w]) for k, w in enumerate(waves)] + [(10_000, 0, 0, None)], "frame_id int, x int, y int, hist array<bigint>")
    got = sorted((r.frame_id, r.bin, r.height, r.prominence, round(r.width, 9)) for r in P.find_peaks(rows, **options).collect())
    assert got == sorted((k, *p) for k, w in enumerate(waves) for p in slow_peaks(w, **options))


def test_edges_and_plateaus():
    def at(*h):
        return P.candidates(np.array(h), np.array([0])).tolist()

    assert at(0, 0, 0) == at(3, 3) == at(5, 1) == at(1, 5) == at(5, 5, 1) == at(1, 5, 5) == []
    assert at(0, 2, 2, 2, 2, 0) == [2]
    assert at(0, 1, 0, 1, 0) == [1, 3]


def test_baseline_steps():
    h = np.random.default_rng(1).integers(0, 20, 90).astype(float)
    w = P.gaussian_weights()
    mirrored = np.concatenate([h[::-1], h, h[::-1]])
    want = [sum(w[k + 4] * mirrored[90 + i + k] for k in range(-4, 5)) for i in range(90)]
    assert np.allclose(P.smooth(h), want)
    padded = np.concatenate([np.zeros(25), h, np.zeros(25)])
    assert np.allclose(P.median_filter(h), [np.median(padded[i : i + 51]) for i in range(90)])
    assert P.deviation(np.array([1.0, 2.0, 9.0])) == 1.0


def test_baseline_peaks_equal_loop(spark, waves):
    rows = spark.createDataFrame([(k, 0, 0, [int(v) for v in w]) for k, w in enumerate(waves)], "frame_id int, x int, y int, hist array<bigint>")
    want = []
    for k, w in enumerate(waves):
        if len(w) and w.sum():
            s = P.smooth(w)
            residual = np.maximum(s - P.median_filter(s), 0)
            mad = np.median(np.abs(residual - np.median(residual)))
            if mad > 0:
                want += [(k, p[0]) for p in slow_peaks(residual, 1.5 * mad, 5, 3 * mad, 1)]
    assert sorted((r.frame_id, r.bin) for r in P.baseline_peaks(rows).collect()) == sorted(want)
