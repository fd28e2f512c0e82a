"""Language identification by Bayesian fusion of text, declared markup language, address suffix and host.

Text speaks through hashed character trigrams (naive Bayes, tempered). What a document declares, its address's suffix
and its host speak through counts of the languages that text alone gives, gathered by grouped aggregation. The address
gives one prior: the host's is drawn towards that of its domain, this towards its suffix's, and this towards that of
all rows. So the suffix speaks once: in full for a host that is hardly known, through the host's own rows else.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Ids that the text model is fitted to at most, those of each language with the smallest hashes; every language has one at least.
MAX_TRAINING = 20_000
#: Cells of trigrams; fewer where the table of all languages would have more than MAX_TABLE entries.
CELLS = 1 << 16
MAX_TABLE = 1 << 23
#: Weight of a trigram's log likelihood: neighbouring trigrams repeat much of what they say.
TEMPER = 0.2
#: Rows that a parent's prior counts for, and declarations that smoothing adds in all.
DRAWN = 20.0
SMOOTH = 2.0
#: Trigrams needed; and the least probability of the best language.
MIN_TRIGRAMS = 1
MIN_PROBABILITY = 0.5
# Labels before a country's that belong to the suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_TAG = re.compile(r"<(?=[A-Za-z/!])")
_RAW = re.compile(r"(?i)<(script|style)\b")
_CLOSES = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_ROOT = re.compile(r"(?i)<html\b")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_LANGUAGE = re.compile(r"[A-Za-z]{2,3}(?![A-Za-z])")


def cells(text: str) -> np.ndarray:
    """Cells of the trigrams of a text's letters, runs of anything else being one space."""
    text = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def plain(text: str) -> str:
    """The text without tags, comments, scripts and styles, each a space. One pass: what is not closed is looked for once only."""
    if "<" not in text or ">" not in text:
        return text
    out, at, open_ended = [], 0, set()
    while tag := _TAG.search(text, at):
        found, end = tag.start(), -1
        if text.startswith("<!--", found):
            if "comment" not in open_ended and (end := text.find("-->", found + 4) + 3) < 3:
                open_ended.add("comment")
                end = -1
        elif raw := _RAW.match(text, found):
            name = raw[1].lower()
            if name not in open_ended:
                close = _CLOSES[name].search(text, raw.end())
                end = close.end() if close else -1
                if not close:
                    open_ended.add(name)
        if end < 0 and not (end := text.find(">", found + 1) + 1):
            break
        out += [text[at:found], " "]
        at = end
    return "".join([*out, text[at:]])


def declared(text: str | None) -> str | None:
    """The language of the attribute lang of the first html tag, in lower case."""
    root = _ROOT.search(text) if text and "<" in text else None
    if not root or (end := text.find(">", root.end())) < 0:
        return None
    for name, value in _ATTRIBUTE.findall(text, root.end(), end):
        if name.lower() == "lang":
            found = _LANGUAGE.match(value.strip("\"' "))
            return found[0].lower() if found else None
    return None


def suffix_of(host: str | None) -> tuple[str | None, str | None]:
    """Suffix and domain of a host name: the last label, or two under a country; and one label more."""
    labels = (host or "").split(".")
    if len(labels) < 2:
        return None, None
    n = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else 1
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


class TextModel:
    """Log probabilities of cells under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.cells = len(counts)
        self.shift = np.uint32(CELLS.bit_length() - self.cells.bit_length())
        total = counts.sum(axis=0, keepdims=True)
        self.table = np.log((counts + 0.05) / (total + 0.05 * self.cells)).astype(np.float32)

    def scores(self, text: str | None) -> tuple[list[float], int]:
        """Summed log likelihoods over those of an even spread over all cells, and the number of trigrams."""
        found = cells(plain(text or ""))
        if not len(found) or not self.languages:
            return [0.0] * len(self.languages), len(found)
        kinds, counts = np.unique(found >> self.shift, return_counts=True)
        total = counts @ self.table[kinds].astype(np.float64)
        return (total + len(found) * math.log(self.cells)).tolist(), len(found)


def cells_for(languages: int) -> int:
    """Cells of a table of so many languages: a power of two, CELLS at most and 1,024 at least."""
    found = CELLS
    while found > 1 << 10 and found * languages > MAX_TABLE:
        found >>= 1
    return found


def quota(sizes: list[int], most: int) -> int:
    """The largest number of ids per language with which all languages together have `most` at most; one at least."""
    left = most
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return max([1, *sizes])


def _sample(ids: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """id, lang: of ids (id, lang, hash) those with the smallest hashes of each language, about `most` in all.

    The hash's share of its range goes down with the language's size, so only about as many ids as are kept meet in the ranking.
    """
    each = quota(list(sizes.values()), most)
    wanted = each + 6 * math.sqrt(each) + 10
    limits = pa.table({"lang": pa.array(list(sizes), pa.string()), "cut": pa.array([-1.0 + 2.0 * min(1.0, 1.1 * wanted / n) for n in sizes.values()], pa.float64())})
    cut = F.broadcast(ids.sparkSession.createDataFrame(limits))  # an Arrow table: rows would take a second set of Python workers on each executor
    near = ids.join(cut, "lang").where((F.col("cut") >= 1) | (F.col("hash") / F.lit(2.0**63) <= F.col("cut"))).select("id", "lang", "hash").distinct()
    least = ids.groupBy("lang").agg(F.min(F.struct("hash", "id")).alias("s")).select("s.id", "lang", "s.hash")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    return near.unionByName(least).distinct().withColumn("_rank", rank).where(F.col("_rank") <= each).select("id", "lang")


def fit(labelled: DataFrame, max_training: int = MAX_TRAINING) -> TextModel:
    """The text model of rows (id, text, lang); rows without id or lang are left out. Every language that has a row is in it."""
    rows = labelled.where("id IS NOT NULL AND lang IS NOT NULL").select("id", F.col("text").cast("string").alias("text"), F.lower(F.substring_index("lang", "-", 1)).alias("lang"))
    ids = rows.select("id", "lang", F.xxhash64("id").alias("hash"))
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    size = cells_for(len(sizes))
    shift = np.uint32(CELLS.bit_length() - size.bit_length())
    if not sizes:
        return TextModel([], np.zeros((size, 0)))
    picked = F.broadcast(shared.written(_sample(ids, sizes, max_training), "lang-sample"))
    languages = sorted(sizes)
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(cells(plain(text.as_py() or "")) >> shift)
            for lang, found in by_lang.items():
                counts = np.bincount(np.concatenate(found), minlength=size)
                at = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(np.full(len(at), place[lang]), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "cell", "n"])

    counted = rows.join(picked, ["id", "lang"], "left_semi").select("text", "lang").mapInArrow(run, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((size, len(languages)))
    table = counted.toArrow()  # MAX_TABLE rows at most, or 1,024 a language
    counts[table["cell"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    return TextModel(languages, counts)


def _evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (id, text, url, host and others, carried but for text) with scores, trigrams, spoken (best by text), declared, suffix, host and domain."""
    text_at = rows.columns.index("text")
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(t.as_py()) for t in batch.column(text_at)]
            heads = [declared(t.as_py()) for t in batch.column(text_at)]
            arrays = [c for k, c in enumerate(batch.columns) if k != text_at]
            arrays += [pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.int64()), pa.array(heads, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "scores", "trigrams", "declared"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", scores array<double>, trigrams long, declared string"
    out = rows.mapInArrow(run, schema)
    languages = _words(model.languages)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    host = F.when(host != "", host).otherwise(F.lower(F.trim("host")))
    out = out.withColumn("host", F.when(host != "", host))
    out = out.withColumn("suffix", _suffix(F.col("host"))).withColumn("domain", _domain(F.col("host")))
    enough = F.col("trigrams") >= MIN_TRIGRAMS
    spoken = F.when(enough, F.array_position("scores", F.array_max("scores")).cast("int"))  # from 1
    return out.withColumn("spoken", spoken).withColumn("declared", F.when(F.array_contains(languages, F.col("declared")), F.col("declared")))


def _suffix(host: Column) -> Column:
    """As suffix_of(); null without a dot."""
    two = F.substring_index(host, ".", -2)
    deep = (F.length(F.substring_index(host, ".", -1)) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL) & (host != two)
    return F.when(host.contains("."), F.when(deep, two).otherwise(F.substring_index(host, ".", -1)))


def _domain(host: Column) -> Column:
    return F.when(_suffix(host).contains("."), F.substring_index(host, ".", -3)).when(host.contains("."), F.substring_index(host, ".", -2))


def _numbers(values: Iterable[float]) -> Column:
    """A literal array of doubles."""
    return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in values) + ")")


def _words(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return F.expr("array(" + ",".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in values) + ")")


def _tallies(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, n, tally (rows spoken in each language) of each key, from counts by key and language: no plan grows with the number of languages."""
    each = rows.where(F.col(key).isNotNull()).groupBy(key, "spoken").agg(F.count(F.lit(1)).alias("_c"))
    entry = F.when(F.col("spoken").isNotNull(), F.struct("spoken", F.col("_c").cast("double")))
    counts = each.groupBy(key).agg(F.sum("_c").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("_m"))  # a key has an entry for each language at most
    return counts.select(key, "n", F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0))).alias("tally"))


def _drawn(tally: Column, parent: Column) -> Column:
    """A prior from counts, drawn towards the parent's."""
    total = F.aggregate(tally, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(tally, parent, lambda x, p: (x + F.lit(DRAWN) * p) / (total + F.lit(DRAWN)))


#: Columns of a result, and those that only stand between.
WORKING = ("lang", "probability", "accepted", "declared", "suffix", "domain", "spoken", "scores", "trigrams", "prior", "by_declared", "n", "_sums", "_most", "_bucket", "_slots", "_slot")


def _by_language(rows: DataFrame, size: int) -> np.ndarray:
    """Rows spoken in each of the model's languages."""
    out = np.zeros(size)
    for r in rows.where("spoken IS NOT NULL").groupBy("spoken").agg(F.count(F.lit(1)).alias("n")).collect():  # as many rows as the model has languages
        out[r["spoken"] - 1] = r["n"]
    return out


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """The language of each row of rows (id, text, url, host; further columns are carried, text is not).

    Result: the carried columns with lang, probability, accepted, declared, suffix, host. A row is accepted if its
    best language has at least MIN_PROBABILITY, its text has MIN_TRIGRAMS trigrams, and some language tells more of
    the text than an even spread of trigrams does; else it is rejected.

    Defined results: a null or empty text, and a text without letters, is rejected, its lang what the other evidence
    says; an unknown declared language counts as none; without an address the host column stands for the host; null
    hosts have the prior of all rows; rows with repeated ids are judged one by one; columns named like a result, or like
    a working column (see WORKING), are replaced.
    """
    size = len(model.languages)
    rows = shared.without(rows, *WORKING)
    if not size:
        empty = rows.drop("text")
        for name, kind in (("lang", "string"), ("probability", "double"), ("declared", "string"), ("suffix", "string")):
            empty = empty.withColumn(name, F.lit(None).cast(kind))
        return empty.withColumn("accepted", F.lit(False))
    seen = shared.written(_evidence(rows, model), "lang-evidence")
    counts = _by_language(seen, size) + 1.0
    base = _numbers(counts / counts.sum())

    # what languages declare, and the share of each suffix in each language
    paired = seen.where("spoken IS NOT NULL AND declared IS NOT NULL")
    of = _by_language(paired, size)
    unsaid = _numbers(np.log(SMOOTH / size / (of + SMOOTH)))
    said = F.zip_with("tally", _numbers(of), lambda n, total: F.log((n + F.lit(SMOOTH / size)) / (total + F.lit(SMOOTH))))
    by_declared = shared.written(_tallies(paired, "declared", size).select("declared", said.alias("by_declared"), F.col("n").alias("rows")), "lang-declared")

    suffixes = _tallies(seen, "suffix", size)
    suffixes = shared.written(suffixes.select("suffix", _drawn(F.col("tally"), base).alias("prior"), F.col("n").alias("rows")), "lang-suffixes")
    domains = _tallies(seen, "domain", size).withColumn("suffix", _suffix(F.col("domain")))
    domains = _joined(domains.withColumnRenamed("n", "rows"), suffixes.select("suffix", "prior"), "suffix", base)
    domains = shared.written(domains.select("domain", _drawn(F.col("tally"), F.col("prior")).alias("prior"), "rows"), "lang-domains")
    hosts = _tallies(seen, "host", size).withColumn("domain", _domain(F.col("host")))
    hosts = _joined(hosts.withColumnRenamed("n", "rows"), domains.select("domain", "prior"), "domain", base)
    hosts = shared.written(hosts.select("host", _drawn(F.col("tally"), F.col("prior")).alias("prior"), F.col("rows").alias("n")), "lang-hosts")

    joined = shared.join_groups(seen, hosts, ["host"], "n")
    joined = shared.join_groups(joined, by_declared, ["declared"], "rows")
    none = F.when(F.col("declared").isNotNull(), unsaid).otherwise(F.array_repeat(F.lit(0.0), size))
    sums = F.transform("scores", lambda s: s * TEMPER)
    for part in (F.coalesce("by_declared", none), F.transform(F.coalesce("prior", base), lambda p: F.log(p))):
        sums = F.zip_with(sums, part, lambda a, b: a + b)
    joined = joined.withColumn("_sums", sums).withColumn("_most", F.array_max("_sums"))
    weight = F.aggregate(F.transform("_sums", lambda s: F.exp(s - F.col("_most"))), F.lit(0.0), lambda a, x: a + x)
    languages = _words(model.languages)
    joined = joined.withColumn("lang", F.element_at(languages, F.array_position("_sums", F.col("_most")).cast("int"))).withColumn("probability", 1.0 / weight)
    accepted = (F.col("probability") >= MIN_PROBABILITY) & (F.col("trigrams") >= MIN_TRIGRAMS) & (F.array_max("scores") > 0)
    names = [c for c in rows.columns if c not in ("text", "host")]
    return joined.withColumn("accepted", accepted).select(*names, "lang", "probability", "accepted", "declared", "suffix", "host")


def _joined(children: DataFrame, parents: DataFrame, key: str, base: Column) -> DataFrame:
    """children with the parent's prior; a parent with a large share of the children is joined by broadcast."""
    children = shared.written(children, "lang-children")
    sizes = children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    groups = shared.written(parents.join(sizes, key), "lang-parents")
    return shared.join_groups(children, groups, [key], "n").withColumn("prior", F.coalesce("prior", base))


def of_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id") -> DataFrame:
    """identify() for documents (id_col, text, source): the source stands for the host."""
    return identify(docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("url"), F.col("source").cast("string").alias("host")), model)


def model_of(docs: DataFrame) -> TextModel:
    return fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id), each row judged for itself: nulls, empty texts, repeated ids and clashing columns as in identify()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), "text", none.alias("url"), F.col("source").alias("host"), F.lit("document").alias("kind"))
    rows = rows.unionByName(pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url", none.alias("host"), F.lit("page").alias("kind")))
    found = identify(rows, model_of(docs))
    doc, page = (F.when(F.col("kind") == k, F.col("id")) for k in ("document", "page"))
    return found.select(doc.alias("doc_id"), page.alias("page_id"), "lang", F.round("probability", 6).alias("probability"), "accepted", "declared", "suffix", "host")
