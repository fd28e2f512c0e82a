"""Fill-in-middle transformation: documents cut into prefix, middle and suffix at unit ends found in 64-bit words of their UTF-8 bytes.

A unit is a run of other characters with the white space before it, or the white space that a text ends in. All texts of
a batch lie in one buffer, read as words of eight bytes. Arithmetic on whole words marks the bytes in which a unit
ends; bits are counted by word and summed up. So the place of the k-th unit's end is found by a search in the sums for its word, and
then by a comparison of eight running counts inside that word. Characters are counted the same way, by the bytes that continue one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import shared

SEED = 42
#: Percent of documents that are transformed, and of those percent with the suffix first.
FIM_PERCENT = 50
SPM_PERCENT = 80
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of texts that are worked on at once, one text at least.
STEP = 8 << 20
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_1, _7, _8, _56 = (np.uint64(k) for k in (1, 7, 8, 56))


def _every(byte: int) -> np.uint64:
    """A word with this byte in all places."""
    return np.uint64(byte) * _ONES


def white_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is white space (0x20 or 0x09 to 0x0D). Sums of seven-bit values never carry into the next byte."""
    low = words & _LOW
    other = (low ^ _every(0x20)) + _LOW
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E))
    return (control | ~other) & ~words & _HIGH


def continuing_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that continues a UTF-8 character."""
    return words & ~(words << _1) & _HIGH


class Marks:
    """Rank and select over marked bytes, given as words with the high bit of each such byte."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        inside = self.words[np.minimum(word, len(self.words) - 1)] & ((_1 << (byte * _8)) - _1)
        return self.sums[word] + np.bitwise_count(inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The place of the marked byte of each number, counted from 1."""
        word = np.searchsorted(self.sums, number, side="left") - 1
        left = (number - self.sums[word]).astype(np.uint64)
        counts = (self.words[word] >> _7) * _ONES  # each byte: marked bytes up to it
        reached = ((counts | _HIGH) - left * _ONES) & _HIGH
        return word * 8 + np.bitwise_count(~reached & _HIGH)


def unit_marks(data: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Bytes in which a unit ends, and bytes that continue a character, of texts that end at `ends` in data; empty texts repeat an end."""
    padded = np.full(len(data) // 8 * 8 + 8, 0x20, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    white = white_bytes(words)
    after = white >> _8
    after[:-1] |= (white[1:] & np.uint64(0x80)) << _56
    marked = ~white & after & _HIGH
    if len(data):
        last = np.unique(ends)
        marked.view(np.uint8)[last[last > 0] - 1] |= 0x80  # a text's last byte ends a unit, white space too
    return Marks(marked), Marks(continuing_bytes(words))


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> dict[str, np.ndarray]:
    """For texts data[offsets[k]:offsets[k + 1]] and their draws (two columns): number of units, and bytes and characters of prefix and middle."""
    begin, end = offsets[:-1], offsets[1:]
    units, continuing = unit_marks(data, end[end > begin])
    before = units.rank(begin)
    n = units.rank(end) - before
    chosen = np.sort(draws % (n + 1)[:, None], axis=1)
    place = np.stack([begin, begin], axis=1)
    some = chosen > 0
    place[some] = units.select((before[:, None] + chosen)[some]) + 1
    inner, first, second = (continuing.rank(x) for x in (begin, place[:, 0], place[:, 1]))
    a, b = place[:, 0] - begin, place[:, 1] - place[:, 0]
    return {"n": n, "a": a, "b": b, "a_chars": a - (first - inner), "b_chars": b - (second - first)}


def _group(number: int, digest: Column) -> Column:
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    The draws are numbers from the SHA-256 of "seed:id", so a document is cut alike in every run, and no row depends on
    another: there is no shuffle. A text that is empty or holds a mark stays plain, so that restored() gives back every text.

    Defined results: a null text counts as empty; a null id draws as an empty one; rows are cut for themselves, so rows that repeat give
    repeated results and rows of one id draw alike; extra columns are kept and those named like a result column replaced;
    an empty table gives an empty table.
    """
    docs = shared.without(docs, *RESULT)
    own, digest = [f.name for f in docs.schema.fields], F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(shared.column_of(docs, id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    names = [shared.own(docs, f"_h{k}") for k in range(4)]
    bytes_of, found_in = shared.own(docs, "_bytes"), len(own)
    p, s, m = (x.encode() for x in marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sizes = batch.column(found_in).slice(at)
                ends = np.frombuffer(sizes.buffers()[1], np.int32 if sizes.type == pa.binary() else np.int64)[sizes.offset : sizes.offset + len(sizes) + 1].astype(np.int64)
                count = max(1, int(np.searchsorted(ends, ends[0] + STEP, side="right")) - 1)
                yield part(batch.slice(at, count), ends[: count + 1])
                at += count

    def part(rows: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
        buffer = rows.column(found_in).buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.empty(0, np.uint8)
        offsets = ends - ends[0]
        h = [rows.column(found_in + 1 + k).to_numpy(zero_copy_only=False) for k in range(4)]
        found = cuts(data, offsets, np.stack(h[:2], axis=1))
        flat, forms, whole = data.tobytes(), [], []
        each = (x.tolist() for x in (offsets[:-1], offsets[1:], found["a"], found["a"] + found["b"], h[2] % 100, h[3] % 100))
        for x, y, a, b, third, fourth in zip(*each, strict=True):
            text = flat[x:y]
            if not text or third >= fim_percent or p in text or s in text or m in text:
                forms.append("plain")
                whole.append(text)
            elif fourth < spm_percent:
                forms.append("spm")
                whole.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
            else:
                forms.append("psm")
                whole.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [pa.array(found["n"], pa.int64()), pa.array(forms, pa.string()), pa.array(found["a_chars"], pa.int64(), mask=plain), pa.array(found["b_chars"], pa.int64(), mask=plain)]
        columns.append(pa.Array.from_buffers(pa.string(), len(whole), pa.array(whole, pa.binary()).buffers()))
        return pa.RecordBatch.from_arrays([*rows.columns[:found_in], *columns], names=[*own, *RESULT])

    kinds = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}
    schema = StructType([*docs.schema.fields, *[StructField(c, kinds[c]) for c in RESULT]])
    text = F.coalesce(shared.column_of(docs, text_col).cast("string"), F.lit("")).cast("binary")
    return docs.withColumns({bytes_of: text} | {name: _group(k, digest) for k, name in enumerate(names)}).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() made output of. Marks occur once each, since texts that hold one stay plain."""
    p, s, m = (F.lit(x) for x in marks)

    def back(first: Column, second: Column, third: Column) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.length(first) + 1, F.length(output))
        behind = F.split_part(rest, second, F.lit(2))
        return F.split_part(rest, second, F.lit(1)), F.split_part(behind, third, F.lit(1)), F.split_part(behind, third, F.lit(2))

    prefix, suffix, middle = back(p, s, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = back(s, p, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """fill_in_middle() of the whole documents table with digests of outputs and of the texts restored from them; edge cases as defined there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = restored(F.col("output"), F.col("form"))
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
     r AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
                  ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d FROM u),
     s AS (SELECT doc_id, n, t, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
                  array_to_string(units[greatest(a, b) + 1:], '') AS suffix,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM s
"""
