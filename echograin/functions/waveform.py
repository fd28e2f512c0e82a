"""Column functions over one waveform (array of counts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echograin import constants as C


def pick_index(i: Column, n: int | Column, m: int) -> Column:
    """The i-th of m whole numbers spread evenly over 0 .. n - 1, both ends included, rounded down."""
    n = F.lit(n) if isinstance(n, int) else n
    if m == 1:
        return F.lit(0)
    step = (n - 1).cast("double") / F.lit(float(m - 1))
    return F.when(i == m - 1, n - 1).otherwise(F.floor(i * step)).cast("int")


def parse_hist(text: Column) -> Column:
    """Counts of a string like "[1 2 3]"; an empty list gives an empty array."""
    parts = F.split(F.trim(F.regexp_replace(F.trim(text), r"^\[+|\]+$", "")), r"\s+")
    return F.transform(F.filter(parts, lambda v: v != ""), lambda v: v.cast("bigint"))


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("bigint"), lambda a, v: a + v)


def strongest_bin(hist: Column) -> Column:
    """First bin of the largest count."""
    return (F.array_position(hist, F.array_max(hist)) - 1).cast("int")


def centroid_bin(hist: Column) -> Column:
    """Mean bin weighted by counts, cut to a whole number; null for an all-zero waveform."""
    weighted = F.aggregate(F.transform(hist, lambda v, i: v * i), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return F.floor(F.try_divide(weighted, total(hist))).cast("int")


def average_bin(hist: Column) -> Column:
    """Mean of the bins with counts, cut to a whole number; null for an all-zero waveform."""
    bins = F.filter(F.transform(hist, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    return F.floor(F.try_divide(F.aggregate(bins, F.lit(0), lambda a, i: a + i), F.size(bins))).cast("int")


def block_gain(y: Column) -> Column:
    """Gain of a line by its block; 1 outside the blocks."""
    block = F.floor((y + C.BLOCK_SHIFT) / C.BLOCK_LINES).cast("int")
    inside = (block >= 0) & (block < len(C.BLOCK_GAINS))
    return F.when(inside, F.get(F.array(*[F.lit(g) for g in C.BLOCK_GAINS]), block)).otherwise(1.0)


def normalise(hist: Column, gain: Column | float, stack: int) -> Column:
    """Counts over the largest that `stack` shots can give."""
    gain = F.lit(float(gain)) if isinstance(gain, (int, float)) else gain
    return F.transform(hist, lambda h: h * gain / F.lit(float(18 * 8 * stack)))


def plateau(hist: Column, bin_: Column) -> Column:
    """How many neighbours, left and right without a gap, share the bin's count."""
    value = F.get(hist, bin_)
    n = F.size(hist)
    left = F.slice(hist, F.lit(1), bin_)
    right = F.slice(hist, bin_ + 2, F.greatest(n - bin_ - 1, F.lit(0)))
    last_other = F.array_max(F.transform(left, lambda v, i: F.when(v != value, i)))
    first_other = F.array_min(F.transform(right, lambda v, i: F.when(v != value, i)))
    return (F.coalesce(bin_ - 1 - last_other, bin_) + F.coalesce(first_other, F.greatest(n - bin_ - 1, F.lit(0)))).cast("int")


def simple_range(bin_: Column, offset: int = 0, mode: int = 15) -> Column:
    """Metres from the bin alone; 0 in other sensor modes than 15."""
    return (bin_ - offset) * F.lit(C.METRES_PER_BIN) if mode == 15 else F.lit(0.0)


def fwhm(start: Column, end: Column, code: Column, above_half: Column, height: Column, saturation: int | None = None, bin_offset: int = 0) -> Column:
    """Range of a peak from the middle of its full width at half maximum: a struct of distance_m and notes.

    start, end, code and above_half are columns of the peak kernel (peaks.FWHM); bin_offset are bins that were cut off before.
    """
    distance = ((start + end) / 2 + bin_offset) * F.lit(C.METRES_PER_BIN) - F.lit(C.RANGE_OFFSET)
    bit = lambda k, text: F.when(code.bitwiseAND(F.lit(k)) != 0, text)
    notes = [
        bit(1, "no half maximum on the left"), bit(2, "flat on the left"), bit(4, "no half maximum on the right"), bit(8, "flat on the right"),
        F.when(height >= saturation, "saturated") if saturation is not None else F.lit(None).cast("string"),
        F.when(above_half > 1, "several peaks above half maximum"), F.when(distance < 0, "negative distance"),
    ]
    return F.struct(distance.alias("distance_m"), F.array_compact(F.array(*notes)).alias("notes"))


def logits_to_label(logits: Column, threshold: float | None = None, below: int = C.NOISE, ignored: tuple[int, ...] = ()) -> Column:
    """Struct of label and confidence. With a threshold, a largest probability under it gives `below`; ignored classes never win."""
    used = F.transform(logits, lambda v, i: F.when(i.isin(*ignored), F.lit(-1e9)).otherwise(v.cast("double"))) if ignored else F.transform(logits, lambda v: v.cast("double"))
    most = F.array_max(used)
    confidence = 1.0 / F.aggregate(F.transform(used, lambda v: F.exp(v - most)), F.lit(0.0), lambda a, v: a + v)
    label = (F.array_position(used, most) - 1).cast("int")
    if threshold is not None:
        label = F.when(confidence < threshold, F.lit(below)).otherwise(label)
    return F.struct(label.alias("label"), confidence.alias("confidence"))
