"""Peak detection in waveforms: one vectorised Arrow kernel, and the selections built on it.

The kernel follows the public documentation of find_peaks: strict rise, optional plateau, strict fall; then the
conditions on height, distance, prominence and width in this order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograin.functions import waveform as W

from . import outcomes

KEYS = ["frame_id", "x", "y"]
#: Waveforms that the kernel handles at once.
BATCH = 2000


def candidates(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of local maxima in waveforms laid end to end; `starts` are the places where each begins. Plateaus count once, at their middle; what touches a waveform's edge does not."""
    if not len(flat):
        return np.empty(0, np.int64)
    first = np.zeros(len(flat), bool)
    first[starts[starts < len(flat)]] = True
    begin = np.flatnonzero(first | np.concatenate([[True], flat[1:] != flat[:-1]]))
    end = np.append(begin[1:], len(flat)) - 1
    value = flat[begin]
    edge_left = first[begin]
    edge_right = np.append(edge_left[1:], True)
    above_left = np.concatenate([[False], value[1:] > value[:-1]])
    above_right = np.append(value[:-1] > value[1:], False)
    good = above_left & above_right & ~edge_left & ~edge_right
    return (begin[good] + end[good]) // 2


def far_apart(places: np.ndarray, heights: np.ndarray, distance: float) -> np.ndarray:
    """Which peaks stay when, highest first (at a tie the lower bin), each drops neighbours nearer than the distance."""
    keep = np.ones(len(places), bool)
    reach = int(np.ceil(distance))
    for k in np.lexsort((places, -heights)):
        if keep[k]:
            near = np.abs(places - places[k]) < reach
            near[k] = False
            keep[near] = False
    return keep


def _bases(flat: np.ndarray, places: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """From each peak outwards, until a higher bin or the place `limit` comes: the nearest bin of the smallest count. All peaks walk at once; those that have stopped drop out."""
    base, low, top = places.copy(), flat[places].copy(), flat[places]
    on, at = np.arange(len(places)), places.copy()
    while len(on):
        at = at + step
        inside = at != limit[on]
        on, at = on[inside], at[inside]
        value = flat[at]
        walks = value <= top[on]
        on, at, value = on[walks], at[walks], value[walks]
        lower = value < low[on]
        low[on[lower]], base[on[lower]] = value[lower], at[lower]
    return base


def _crossings(flat: np.ndarray, places: np.ndarray, step: int, base: np.ndarray, level: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """From each peak towards its base, where the waveform comes down to the level, between bins; counted from the waveform's begin, so that rounding does not depend on the batch."""
    found = np.zeros(len(places))
    on, at = np.arange(len(places)), places.copy()
    while len(on):
        walks = (at != base[on]) & (flat[at] > level[on])
        stop = ~walks
        ended, spot = on[stop], at[stop]
        value, beside = flat[spot].astype(float), flat[np.clip(spot - step, 0, len(flat) - 1)].astype(float)
        part = np.divide(level[ended] - value, beside - value, out=np.zeros(len(spot)), where=value < level[ended])
        found[ended] = (spot - begins[ended]) - step * part
        on, at = on[walks], at[walks] + step
    return found


def measure(flat: np.ndarray, places: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prominence of the peaks at places of waveforms laid end to end, and width at half prominence; begins and ends are those of each peak's waveform."""
    left, right = _bases(flat, places, -1, begins - 1), _bases(flat, places, 1, ends)
    prominence = (flat[places] - np.maximum(flat[left], flat[right])).astype(float)
    level = flat[places] - prominence * 0.5
    return prominence, _crossings(flat, places, 1, right, level, begins) - _crossings(flat, places, -1, left, level, begins)


def _nearest_half(flat: np.ndarray, places: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """From each place outwards, the nearest place at or below half its count; -1 where the place `limit` comes first."""
    found, half = np.full(len(places), -1, np.int64), flat[places] / 2
    on, at = np.arange(len(places)), places.copy()
    while len(on):
        at = at + step
        inside = at != limit[on]
        on, at = on[inside], at[inside]
        low = flat[at] <= half[on]
        found[on[low]] = at[low]
        on, at = on[~low], at[~low]
    return found


#: Bits of the column fwhm_code.
NO_LEFT, FLAT_LEFT, NO_RIGHT, FLAT_RIGHT = 1, 2, 4, 8
FWHM = "start_fwhm_bin double, end_fwhm_bin double, fwhm_code int, above_half int"


def half_widths(flat: np.ndarray, places: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each place's waveform comes down to half its count, between bins, on the left and the right, and bits on what is missing: without such a bin the place itself stands in."""
    bins, half, code = (places - begins).astype(float), flat[places] / 2.0, np.zeros(len(places), np.int32)
    out = []
    for step, limit, none, even in ((-1, begins - 1, NO_LEFT, FLAT_LEFT), (1, ends, NO_RIGHT, FLAT_RIGHT)):
        at = _nearest_half(flat, places, step, limit)
        there = at >= 0
        spot = np.where(there, at, places)
        slope = flat[np.clip(spot - step, 0, max(0, len(flat) - 1))].astype(float) - flat[spot]
        rises = there & (slope != 0)
        part = np.divide(half - flat[spot], slope, out=np.zeros(len(places)), where=rises)
        out.append(np.where(there, (spot - begins) - step * part, bins))
        code |= np.where(there, np.where(rises, 0, even), none).astype(np.int32)
    return out[0], out[1], code


def _at_least(rows: np.ndarray, tops: np.ndarray, of: np.ndarray, least: np.ndarray) -> np.ndarray:
    """How many of the peaks (row, top), sorted by row, are in the row `of` and reach `least`."""
    order = np.lexsort((tops, rows))
    sorted_rows, sorted_tops = rows[order], tops[order]
    low, high = np.searchsorted(sorted_rows, of), np.searchsorted(sorted_rows, of, side="right")
    end = high.copy()
    while (open_ := low < high).any():  # bisection inside each row
        middle = (low + high) // 2
        small = np.zeros(len(of), bool)
        small[open_] = sorted_tops[middle[open_]] < least[open_]
        low, high = np.where(open_ & small, middle + 1, low), np.where(open_ & ~small, middle, high)
    return (end - low).astype(np.int32)


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column laid end to end, and each list's begin and length; nulls are empty."""
    lengths = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.cumsum(lengths) - lengths, lengths


def _mapped(rows: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], keys: int, size: int, schema: str, errors: bool) -> DataFrame:
    """rows by the kernel, `size` rows at a time; with errors, failures are rows."""
    guard = outcomes.guarded(kernel, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, size) for b in batches for at in range(0, b.num_rows, size)):
            if errors:
                yield from guard(batch)
            else:
                yield kernel(batch)

    return rows.mapInArrow(run, schema + ", error string" * errors)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def whole_counts(column: pa.Array) -> None:
    """Raises where waveforms have counts that are null or no numbers."""
    values = column.flatten()
    if values.null_count or (pa.types.is_floating(values.type) and np.isnan(values.to_numpy(zero_copy_only=False)).any()):
        raise ValueError("a waveform has null counts")


def _by_height(row: np.ndarray, top: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rank of each peak inside its row, from 1: the higher first, at a tie the lower bin. Rows are in order."""
    order = np.lexsort((place, -top, row))
    rank = np.empty(len(row), np.int32)
    rank[order] = np.arange(len(row)) - np.searchsorted(row, row[order]) + 1
    return rank


def _conditions(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, every: tuple[np.ndarray, np.ndarray, np.ndarray], low: np.ndarray, distance: float | None, prominence: float | None, width: float | None, need: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, rows, heights and measures (prominence and width) of the candidates that meet the conditions, in their order."""
    place, row, top = every
    good = ~(top < low[row])  # a null threshold is no condition
    place, row, top = place[good], row[good], top[good]
    if distance is not None and len(place):
        cuts = np.flatnonzero(np.diff(row)) + 1
        keep = np.concatenate([far_apart(p, t, distance) for p, t in zip(np.split(place, cuts), np.split(top, cuts), strict=True)])
        place, row, top = place[keep], row[keep], top[keep]
    found = np.full((len(place), 2), np.nan)
    if need:
        found[:, 0], found[:, 1] = measure(flat, place, starts[row], starts[row] + lengths[row])
    good = np.ones(len(place), bool)
    if prominence is not None:
        good &= found[:, 0] >= prominence
    if width is not None:
        good &= found[:, 1] >= width
    return place[good], row[good], top[good], found[good]


def peaks_of(hists: pa.Array, low: np.ndarray, distance: float | None = None, prominence: float | None = None, width: float | None = None) -> Iterator[tuple[int, int, float, float, float]]:
    """Number of the waveform, bin, height, prominence and width of the peaks of a list array; low is the least height of each waveform."""
    whole_counts(hists)
    flat, starts, lengths = _rows_of(hists)
    every = candidates(flat, starts[lengths > 0])
    row = np.searchsorted(starts + lengths, every, side="right")
    place, row, top, found = _conditions(flat, starts, lengths, (every, row, flat[every].astype(float)), low, distance, prominence, width, True)
    return zip(row.tolist(), (place - starts[row]).tolist(), top.tolist(), found[:, 0].tolist(), found[:, 1].tolist(), strict=True)


def find_peaks(rows: DataFrame, keys: list[str] | None = None, height: Column | float | None = None, distance: float | None = None, prominence: float | None = None, width: float | None = None, hist: str = "hist", measured: bool = True, ranged: bool = False, ranked: bool = False, errors: bool = False) -> DataFrame:
    """A row per peak: the keys with bin, height, prominence and width; with `ranged` also the columns FWHM, by which with_fwhm ranges it; with `ranked` its rank by height inside the waveform.

    height may be an expression over the row. Without `measured`, and without a condition on them, prominence and width are null and cost nothing.
    A null or empty waveform, and one without a strict rise and fall, has no peaks. With `errors` there is a last column error: a waveform
    that cannot be worked on, such as one with null counts, is one row of its keys and the error (see outcomes.split); else it ends the job.
    """
    keys = keys or KEYS
    need = measured or prominence is not None or width is not None
    low = F.lit(None) if height is None else height if isinstance(height, Column) else F.lit(float(height))
    chosen = rows.select(*keys, low.cast("double").alias("_low"), F.col(hist).alias("_hist"))
    n = len(keys)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole_counts(batch.column(n + 1))
        flat, starts, lengths = _rows_of(batch.column(n + 1))
        low = batch.column(n).to_numpy(zero_copy_only=False).astype(float)
        every = candidates(flat, starts[lengths > 0])
        every_row = np.searchsorted(starts + lengths, every, side="right")
        every_top = flat[every].astype(float)
        place, row, top, found = _conditions(flat, starts, lengths, (every, every_row, every_top), low, distance, prominence, width, need)
        taken = pa.array(row)
        arrays = [batch.column(k).take(taken) for k in range(n)]
        arrays += [pa.array((place - starts[row]).astype(np.int32)), pa.array(top)]
        arrays += [pa.array(found[:, k], from_pandas=True) for k in range(2)]
        names = [*keys, "bin", "height", "prominence", "width"]
        if ranged:
            arrays += [pa.array(v) for v in half_widths(flat, place, starts[row], starts[row] + lengths[row])]
            arrays.append(pa.array(_at_least(every_row, every_top, row, top / 2)))
            names += [c.split()[0] for c in FWHM.split(", ")]
        if ranked:
            arrays.append(pa.array(_by_height(row, top, place)))
            names.append("rank")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = _fields(rows.select(*keys)) + ", bin int, height double, prominence double, width double" + f", {FWHM}" * ranged + ", rank int" * ranked
    return _mapped(chosen, kernel, n, BATCH, schema, errors)


def at_bins(rows: DataFrame, bins: Column, carried: list[str], first: tuple[float, int] | None = None, hist: str = "hist", errors: bool = False) -> DataFrame:
    """A row for each bin of an array of each row: carried columns, number (its place in the array), bin, height and the columns FWHM.

    With first = (least, top), the row's first peak comes last in number: the earliest of its `top` highest peaks of at
    least `least` counts, else the array's first bin. Bins that are null or outside the waveform are left out. One pass, no shuffle. `errors` as in find_peaks(), the carried columns being the keys.
    """
    chosen = rows.select(*carried, bins.cast("array<int>").alias("_bins"), F.col(hist).alias("_hist"))
    n = len(carried)
    names = [*carried, "number", "bin", "height", *[c.split()[0] for c in FWHM.split(", ")]]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole_counts(batch.column(n + 1))
        flat, starts, lengths = _rows_of(batch.column(n + 1))
        every = candidates(flat, starts[lengths > 0])
        every_row = np.searchsorted(starts + lengths, every, side="right")
        every_top = flat[every].astype(float)
        _, asked_starts, asked_lengths = _rows_of(batch.column(n))
        asked = batch.column(n).flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), asked_lengths)
        number = np.arange(len(asked)) - np.repeat(asked_starts, asked_lengths)
        if first is not None:
            some = every_top >= first[0]
            order = np.lexsort((every[some], -every_top[some], every_row[some]))
            r, p = every_row[some][order], every[some][order]
            best = np.arange(len(r)) - np.searchsorted(r, r) < first[1]
            earliest = np.full(batch.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(earliest, r[best], p[best])
            has = np.flatnonzero(asked_lengths > 0)
            spot = np.where(earliest[has] < np.iinfo(np.int64).max, earliest[has] - starts[has], asked[asked_starts[has]])
            row, number, asked = np.concatenate([row, has]), np.concatenate([number, asked_lengths[has]]), np.concatenate([asked, spot])
        good = (asked >= 0) & (asked < lengths[row])
        row, number, asked = row[good], number[good], asked[good]
        place = starts[row] + asked
        taken = pa.array(row)
        arrays = [batch.column(k).take(taken) for k in range(n)] + [pa.array(number.astype(np.int32)), pa.array(asked.astype(np.int32)), pa.array(flat[place].astype(float))]
        arrays += [pa.array(v) for v in half_widths(flat, place, starts[row], starts[row] + lengths[row])]
        arrays.append(pa.array(_at_least(every_row, every_top, row, flat[place] / 2)))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return _mapped(chosen, kernel, n, BATCH, _fields(rows.select(*carried)) + f", number int, bin int, height double, {FWHM}", errors)


def relative_peaks(rows: DataFrame, share: float = 0.1, width: float | None = 3, distance: float | None = None, keys: list[str] | None = None, ranged: bool = False, errors: bool = False) -> DataFrame:
    """Peaks of at least `share` of their waveform's largest count."""
    return find_peaks(rows, keys, F.array_max("hist") * F.lit(share), distance=distance, width=width, ranged=ranged, errors=errors)


def median(hist: str = "hist") -> Column:
    """Median of a waveform's counts."""
    s, n = F.array_sort(hist), F.size(hist)
    half = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, half).cast("double")).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2.0)


def peaks_above_median(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Peaks of at least the waveform's median, with rank by height (at a tie the lower bin first) and label: the strongest is object, others noise. The kernel ranks them, without a shuffle."""
    keys = keys or KEYS
    found = find_peaks(rows, keys, median(), measured=False, ranked=True).drop("prominence", "width")
    return found.withColumn("label", (F.col("rank") == 1).cast("int"))


def first_peak_bin(rows: DataFrame, least: float = 3, top: int = 2, keys: list[str] | None = None) -> DataFrame:
    """keys and hist with bin: the earliest of the `top` highest peaks of at least `least`, else the strongest bin. Empty waveforms are left out."""
    found = at_bins(rows, F.array(W.strongest_bin(F.col("hist"))), [*(keys or KEYS), "hist"], (least, top))
    return found.where("number = 1").select(*(keys or KEYS), "hist", "bin")


# --- baseline correction --------------------------------------------------------------------------------------------


def gaussian_weights(sigma: float = 1.0, cut: float = 4.0) -> np.ndarray:
    x = np.arange(-int(cut * sigma + 0.5), int(cut * sigma + 0.5) + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def smooth(h: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing of each row; beyond the edges the row is mirrored, edge included."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    padded = np.pad(h.astype(float), [(0, 0)] * (h.ndim - 1) + [(r, r)], mode="symmetric")
    return sum(w[k] * padded[..., k : k + h.shape[-1]] for k in range(len(w)))


def median_filter(h: np.ndarray, size: int = 51) -> np.ndarray:
    """Running median of each row over an odd number of bins; beyond the edges are zeros."""
    r = size // 2
    padded = np.pad(h, [(0, 0)] * (h.ndim - 1) + [(r, r)])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1), axis=-1)


def deviation(residual: np.ndarray) -> np.ndarray:
    """Median absolute deviation of each row."""
    return np.median(np.abs(residual - np.median(residual, axis=-1, keepdims=True)), axis=-1)


def _alike(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the rows of each length, empty ones left out: such rows are handled as one matrix."""
    for n in np.unique(lengths[lengths > 0]):
        yield np.flatnonzero(lengths == n)


def _residual(flat: np.ndarray, starts: np.ndarray, length: int, rows: np.ndarray, sigma: float, kernel: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of rows of one length, smoothed, their baseline, and the deviation of what is above it."""
    h = flat[starts[rows][:, None] + np.arange(length)]
    s = smooth(h, sigma)
    base = median_filter(s, kernel)
    return h, s, base, deviation(np.maximum(s - base, 0.0))


def baseline_peaks(rows: DataFrame, keys: list[str] | None = None, sigma: float = 1.0, kernel: int = 51, factor: float = 3.0, distance: float = 5, width: float = 1, errors: bool = False) -> DataFrame:
    """Peaks above a baseline: keys, bin, height and prominence of the residual, width, and mad.

    Smoothed waveform less its running median, cut at 0; peaks have at least 1.5 deviations of height and `factor` of
    prominence. A waveform that sums to 0 or whose deviation is 0 has none. Waveforms of one length are handled at once. `errors` as in find_peaks().
    """
    keys = keys or KEYS
    n = len(keys)
    names = [*keys, "bin", "height", "prominence", "width", "mad"]

    def peaks_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole_counts(batch.column(n))
        flat, starts, lengths = _rows_of(batch.column(n))
        found = []
        for alike in _alike(lengths):
            size = int(lengths[alike[0]])
            h, s, base, mad = _residual(flat, starts, size, alike, sigma, kernel)
            some = (h.sum(axis=1) != 0) & (mad != 0)
            alike, mad = alike[some], mad[some]
            residual = np.maximum(s - base, 0.0)[some].ravel()
            place = candidates(residual, np.arange(len(alike)) * size)
            row = place // size
            high = residual[place] >= 1.5 * mad[row]
            place, row = place[high], row[high]
            if len(place):
                cuts = np.flatnonzero(np.diff(row)) + 1
                keep = np.concatenate([far_apart(p, residual[p], distance) for p in np.split(place, cuts)])
                place, row = place[keep], row[keep]
            prominence, wide = measure(residual, place, row * size, row * size + size)
            good = (prominence >= factor * mad[row]) & (wide >= width)
            place, row = place[good], row[good]
            taken = pa.array(alike[row])
            arrays = [batch.column(k).take(taken) for k in range(n)] + [pa.array((place % size).astype(np.int32))]
            arrays += [pa.array(v) for v in (residual[place], prominence[good], wide[good], mad[row])]
            found.append(pa.RecordBatch.from_arrays(arrays, names=names))
        kinds = [*(batch.schema.field(k).type for k in range(n)), pa.int32(), *[pa.float64()] * 4]
        return pa.concat_batches(found) if found else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)

    schema = _fields(rows.select(*keys)) + ", bin int, height double, prominence double, width double, mad double"
    return _mapped(rows.select(*keys, "hist"), peaks_of, n, 500, schema, errors)


def filtered(rows: DataFrame, keys: list[str] | None = None, sigma: float = 1.0, kernel: int = 51, errors: bool = False) -> DataFrame:
    """keys with smoothed and baseline (arrays), and mad of the residual; an empty waveform has empty arrays and no mad. `errors` as in find_peaks()."""
    keys = keys or KEYS
    n = len(keys)

    def arrays_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole_counts(batch.column(n))
        flat, starts, lengths = _rows_of(batch.column(n))
        parts = [(alike, *_residual(flat, starts, int(lengths[alike[0]]), alike, sigma, kernel)[1:]) for alike in _alike(lengths)]
        empty = np.flatnonzero(lengths == 0)
        parts.append((empty, np.empty((len(empty), 0)), np.empty((len(empty), 0)), np.full(len(empty), np.nan)))
        found = []
        for alike, s, base, mad in parts:
            ends = pa.array(np.arange(len(alike) + 1) * s.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (s, base)]
            arrays = [batch.column(k).take(pa.array(alike)) for k in range(n)] + [*lists, pa.array(mad, from_pandas=True)]
            found.append(pa.RecordBatch.from_arrays(arrays, names=[*keys, "smoothed", "baseline", "mad"]))
        return pa.concat_batches(found)

    schema = _fields(rows.select(*keys)) + ", smoothed array<double>, baseline array<double>, mad double"
    return _mapped(rows.select(*keys, "hist"), arrays_of, n, 500, schema, errors)
