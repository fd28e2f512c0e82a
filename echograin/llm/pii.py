"""Personal data by bootstrapped contextual extraction.

Identifiers of strict form (e-mail, IP and card numbers, phone numbers) are found in every text and are the seeds. Their
left contexts, two or three words and signs, are the lexical patterns. Looser forms of the same kinds are candidates, never taken for
their form alone. Patterns and candidates make a graph: a pattern is trusted as far as the places with its words hold known
identifiers of one kind, and a candidate as far as the patterns that it occurs with. Accepted candidates
count as known in the next round, so they lend trust to further patterns, until a round accepts nothing new.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
#: Least trust in a pattern or candidate; distinct known identifiers that a pattern must have.
CONFIDENCE = 0.5
MIN_SUPPORT = 3
#: Places that count against every pattern; weight of a candidate not accepted, against its pattern.
PRIOR = 1.0
UNKNOWN = 0.1
#: Words and signs of a pattern.
LENGTHS = (2, 3)
#: Characters of a word up to which words are told apart.
WORD_CHARS = 40
#: Texts of a slice of a batch.
SLICE = 500

_ENTITY = "array<struct<kind:int,start:long,end:long,inst:string,left:array<string>>>"
_FOUND = "doc_id {id}, n_email long, n_ip long, n_card long, n_phone long, base string, seeds " + _ENTITY + ", candidates " + _ENTITY
_ARROW_ENTITY = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("inst", pa.string()), ("left", pa.list_(pa.string()))]))

# The strict forms, with quantifiers that never give back, and begun only where a run of their characters begins: linear in the text.
_MAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + _MAIL_HERE.pattern)
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The loose forms.
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_LOOSE_MAIL = re.compile(r"(?<![\w.%+'-])[\w.%+'-]++ ?(?:@|\(at\)|\[at\]) ?[\w-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[\w-]++)*+", re.I)
_LOOSE_IP = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]++")
_LOOSE_NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9]++(?:\)?[ ./-]?\(?[0-9]++)*+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of strict identifiers, leftmost and non-overlapping inside each kind, by kind and start."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        at = 0
        while m := (at and _MAIL_HERE.match(text, at)) or _MAIL.search(text, at):  # behind a match the run goes on
            found.append((0, m.start(), m.end()))
            at = m.end()
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _hex_groups(text: str) -> bool:
    """Whether a run of hexadecimal digits and colons has the form of an IPv6 address."""
    groups = text.split(":")
    short = text.count("::")
    return all(len(g) <= 4 for g in groups) and any(map(str.isdigit, "".join(groups))) and (short == 1 and len(groups) <= 9 or short == 0 and len(groups) == 8 and all(groups))


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates that touch no strict identifier: e-mail addresses without a dot or written out, IPv6
    addresses, card numbers of 12 to 15 digits with a right check digit, phone numbers of 7 to 15 digits without a plus. A number may be a candidate of two kinds."""
    found = []
    if _AT.search(text):
        found += [(0, m.start(), m.end()) for m in _LOOSE_MAIL.finditer(text)]
    if ":" in text:
        found += [(1, m.start(), m.end()) for m in _LOOSE_IP.finditer(text) if not _continues(text, m.end()) and _hex_groups(m[0])]
    for m in _LOOSE_NUMBER.finditer(text):
        if m.end() - m.start() < 7 or _continues(text, m.end()):
            continue
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 15 and luhn(digits):
            found.append((2, m.start(), m.end()))
        if 7 <= len(digits) <= 15:
            found.append((3, m.start(), m.end()))
    strict = sorted((s, e) for _, s, e in taken)
    begins, reach = [s for s, _ in strict], [0, *accumulate((e for _, e in strict), max)]
    return [x for x in found if reach[bisect_left(begins, x[2])] <= x[1]]  # no strict one begins before its end and ends behind its start


def _continues(text: str, at: int) -> bool:
    return at < len(text) and (text[at].isalnum() or text[at] == "_")


def word(token: str) -> str:
    """A word as patterns have it: lower case, digits alike, very long words alike."""
    return "~" if len(token) > WORD_CHARS else _DIGITS.sub("0", token.lower())


def patterns_at(text: str, starts: list[int]) -> list[list[str]]:
    """The patterns of each place (in ascending order): its last 2 and 3 words and signs; "^" stands before the text."""
    out: list[list[str]] = []
    a = b = c = "^"
    for m in _TOKEN.finditer(text):
        while len(out) < len(starts) and starts[len(out)] < m.end():
            out.append([f"{b} {c}", f"{a} {b} {c}"])
        if len(out) == len(starts):
            return out
        a, b, c = b, c, word(m[0])
    return out + [[f"{b} {c}", f"{a} {b} {c}"]] * (len(starts) - len(out))


def instance(kind: int, text: str) -> str:
    """What equal identifiers have in common, however they are written."""
    value = re.sub("[^0-9]", "", text) if kind > 1 else text.lower()
    return value if len(value) <= 64 else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def _entities(text: str, spans: list[tuple[int, int, int]], left: dict[int, list[str]]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "inst": instance(k, text[s:e]), "left": left[s]} for k, s, e in spans]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, numbers of strict identifiers, `base` (their spans as text), seeds and candidates with their patterns; no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns: list[list] = [[] for _ in range(7)]
                for value in part.column(1):
                    text = value.as_py() or ""
                    spans = base_spans(text)
                    loose = loose_spans(text, spans)
                    starts = sorted({s for _, s, _ in spans} | {s for _, s, _ in loose})
                    left = dict(zip(starts, patterns_at(text, starts), strict=True)) if starts else {}
                    counts = Counter(k for k, _, _ in spans)
                    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
                    for column, x in zip(columns, (*(counts[k] for k in range(4)), joined, _entities(text, spans, left), _entities(text, loose, left)), strict=True):
                        column.append(x)
                kinds = [*[pa.int64()] * 4, pa.string(), _ARROW_ENTITY, _ARROW_ENTITY]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "seeds", "candidates"])

    ident = shared.column_of(docs, id_col)
    rows = docs.select(ident.alias("doc_id"), shared.column_of(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _FOUND.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the keys' XXH64 of at most 16 MB, as shared.sieve() has it."""
    need = -(-keys.count() * shared.BITS_EACH // shared.PART_BITS)
    parts = min(shared.MAX_PARTS, 1 << max(0, need - 1).bit_length())
    at = F.pmod(F.xxhash64(key), F.lit(parts * shared.PART_BITS))
    rows = keys.groupBy(F.floor(at / shared.PART_BITS).cast("int").alias("part")).agg(F.bitmap_construct_agg((at % shared.PART_BITS).cast("int")).alias("bits")).collect()  # MAX_PARTS rows at most
    out = np.zeros((parts, shared.PART_BITS // 8), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def occurrences(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """pattern, total: the places in all texts that each of `patterns` (one column, a written table) stands before, whatever follows. A bitmap of bounded size tells tasks what to count."""
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(patterns, "pattern"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, digest = held.value, xxhash.xxh64_intdigest
        last, known = 8 * len(bits) - 1, {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                counts: Counter = Counter()
                for value in batch.column(0).slice(at, SLICE):
                    a = b = c = "^"
                    for m in _TOKEN.finditer(value.as_py() or ""):
                        two = f"{b} {c}"
                        for p in (two, f"{a} {two}"):
                            spot = digest(p, 42) & last
                            if bits[spot >> 3] >> (spot & 7) & 1:
                                counts[p] += 1
                        token = m[0]
                        a, b = b, c
                        c = known.get(token) or known.setdefault(token, word(token))
                    if len(known) > 1 << 16:
                        known.clear()
                yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "total"])

    counted = docs.select(shared.column_of(docs, text_col).cast("string").alias("text")).mapInArrow(run, "pattern string, total long")
    return counted.groupBy("pattern").agg(F.sum("total").alias("total")).join(patterns, "pattern", "left_semi")


def _by_pattern(entities: DataFrame) -> DataFrame:
    return entities.select("kind", "inst", F.explode("left").alias("pattern"))


def _trust(known: Column, total: Column, open_: Column) -> Column:
    """Share of a pattern's places that hold known identifiers; those with open candidates weigh UNKNOWN."""
    return known / (F.greatest(total, known + open_) - (1 - UNKNOWN) * open_ + PRIOR)


def learn(docs: DataFrame, found: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame] | None:
    """Trusted patterns (pattern, kind, confidence, known) and accepted candidates (kind, inst, score, n occurrences) of a written scan(); None if there are no candidates that a pattern could tell of.

    Each round joins the graph's edges (pattern, kind, inst, with their number of places) to what the round before accepted and to the patterns
    trusted then. Edges are distinct, and groups with a large share of them are broadcast or dealt to slots.
    """
    spread = found.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.*")
    edges = shared.written(_by_pattern(spread).groupBy("pattern", "kind", "inst").agg(F.count(F.lit(1)).alias("places")), "pii-edges")
    if edges.isEmpty():
        return None
    keys = shared.written(edges.select("pattern").distinct(), "pii-patterns")
    seeds = _by_pattern(found.where(F.size("seeds") > 0).select(F.explode("seeds").alias("c")).select("c.*"))
    seeds = shared.sieve(seeds, keys, "pattern", "_seen").where("_seen").groupBy("pattern", "kind", "inst").agg(F.count(F.lit(1)).alias("places"))
    seeds = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"), F.sum("places").alias("seed_places"))
    sides = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("places").alias("open"))
    sides = sides.join(seeds, ["pattern", "kind"], "left").fillna(0, ["seeds", "seed_places"]).where(F.col("seeds") + F.col("n") >= MIN_SUPPORT)
    sides = shared.written(sides, "pii-sides")
    if sides.isEmpty():
        return None
    totals = occurrences(docs, text_col, shared.written(sides.select("pattern").distinct(), "pii-patterns"))
    sides = shared.written(sides.join(totals, "pattern", "left").fillna(0, ["total"]), "pii-sides", sides)
    edges = shared.written(shared.join_groups(edges, sides.select("pattern", "kind", "n"), ["pattern", "kind"], "n", "inner"), "pii-edges", edges)
    places = shared.written(spread.groupBy("kind", "inst").agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy("kind", "inst").agg(F.count(F.lit(1)).alias("edges")), ["kind", "inst"]), "pii-instances")
    accepted, before = None, 0
    while True:
        if accepted is None:
            trusted = sides.withColumns({"known": F.col("seeds"), "confidence": _trust(F.col("seed_places"), F.col("total"), F.col("open"))})
        else:
            gained = shared.join_groups(edges, accepted.select("kind", "inst", "edges"), ["kind", "inst"], "edges", "inner").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("g"), F.sum("places").alias("gp"))
            joined = sides.join(gained, ["pattern", "kind"], "left").fillna(0, ["g", "gp"])
            trusted = joined.withColumns({"known": F.col("seeds") + F.col("g"), "confidence": _trust(F.col("seed_places") + F.col("gp"), F.col("total"), F.col("open") - F.col("gp"))})
        trusted = shared.written(trusted.where((F.col("known") >= MIN_SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence", "known", "n"), "pii-trusted")
        doubt = shared.join_groups(edges, trusted.select("pattern", "kind", "confidence", "n"), ["pattern", "kind"], "n", "inner").groupBy("kind", "inst").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        now = shared.written(doubt.where(F.col("score") >= CONFIDENCE).join(places, ["kind", "inst"]), "pii-accepted", *([accepted] if accepted is not None else []))
        accepted, count = now, now.count()
        if count == before:  # a round only adds
            return trusted.drop("n"), accepted
        before = count


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (strict identifiers), base (their spans), n_found and spans (all, those that patterns discovered among them) for every row of docs.

    Spans are kind:start:end in code points, end exclusive, by kind and start, joined by commas. Texts are read twice: for
    identifiers, and, if there are candidates, to count how often patterns stand before something else.
    Of two kinds accepted for one candidate the higher score counts, then the first kind.

    Defined results: a null text counts as empty; every row is read for itself, so rows may repeat, share an id or have
    none; repeated texts count as often as they occur in places, but their identifiers once; extra columns are left out; an empty table gives an empty table.
    """
    found = shared.written(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    plain = ["doc_id", *(f"n_{k}" for k in KINDS), "base"]
    with shared.Scope(docs.sparkSession) as scope:
        learned = learn(docs, found, text_col)
        if learned is not None:
            spread = found.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.kind", "c.start", "c.end", "c.inst")
            placed = shared.join_groups(spread, learned[1].select("kind", "inst", "score", "n"), ["kind", "inst"], "n", "inner")
            placed = placed.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
            placed = placed.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
            placed = shared.written(placed, "pii-placed")
            scope.keep(placed)
    if learned is None:
        return found.select(*plain, F.lit(0).cast("long").alias("n_found"), F.col("base").alias("spans"))
    flagged = shared.sieve(found, shared.written(placed.select("row"), "pii-rows"), "row", "_seen")
    strict = F.transform("seeds", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat(strict, F.coalesce("more", F.array().cast("array<struct<kind:int,start:long,end:long>>"))))
    joined = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    some = flagged.where("_seen").join(placed, "row", "left").select(*plain, F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"), joined.alias("spans"))
    return flagged.where("NOT _seen").select(*plain, F.lit(0).cast("long").alias("n_found"), F.col("base").alias("spans")).unionByName(some)


def op12_personal_data(spark, sf_dir: str) -> DataFrame:
    """find_personal() of the whole documents table, the strict spans as a digest; edge cases as defined there."""
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")
