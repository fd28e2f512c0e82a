"""Written intermediate tables, and joins which hold up under hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of all rows is joined by broadcast; so there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000
#: Rows of one key that may meet in one task; keys with more of them are dealt to several slots.
GROUP_ROWS = 1 << 20
#: Buckets of keys by hash, each with its number of slots: the most rows of that broadcast table.
BUCKETS = 1 << 14

#: Bits of one part of a sieve (Spark's size), bits for each key, and parts at most: 16 MB in all.
PART_BITS = 1 << 15
BITS_EACH = 64
MAX_PARTS = 1 << 12

#: Bytes of a batch for a Python worker, about, and Spark's setting for it. Spark's own bounds are 10,000 rows and 64 MB: such a batch of texts
#: takes tens of MB, which a task holds several times at once, in the JVM and in Python, and neither gives that memory back.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scope:
    """The tables that one call writes; `with` makes it the current one, of this thread alone.

    At its end all of them are deleted but those kept, which then belong to the scope around it, if there is one. A result that is
    still to be computed reads what was kept: put the call and the saving of its result in a scope of your own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t.stored_at for t in tables}

    def __enter__(self) -> Scope:
        self.outer = _scope.get()
        self.token = _scope.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _scope.reset(self.token)
        if self.outer is not None:
            self.outer.made += [p for p in self.made if p in self.kept]
        delete(self.spark, [p for p in self.made if p not in self.kept])


#: The current scope. Threads have one of their own, so queries that run at once leave each other's tables alone.
_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors see. Where it is unset a temporary one is taken on a local master; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.made.append(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers have about BATCH_BYTES in this session, unless the setting was made already. A longer row is a batch of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def written(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors.

    `done` are tables from here that only df was made of: their files are deleted once df is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    delete(spark, [x.stored_at for x in done])
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        scope = _scope.get()
        while scope is not None:
            if path in scope.made:
                scope.made.remove(path)
            scope = scope.outer


def own(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of df has in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", most_rows: int = 0, small: bool = True) -> DataFrame:
    """Join rows to groups (one row per key, with the number of its rows in column `size`); inner or left.

    Groups over HOT_SHARE of the sum of sizes number at most 1 / HOT_SHARE by counting, so they are broadcast and
    their rows are not shuffled (not so with small=False, where a group's own row may be large). All others go through a
    shuffle join; those with more than most_rows (GROUP_ROWS) rows are dealt by a hash of the row to slots of about that many. How many slots a key has stands in a table by buckets of keys,
    BUCKETS rows at most, and groups are repeated for each slot of their bucket.
    Rows whose key is null match nothing. `groups` is read several times and should be a written table; column `size` is not part of the result.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    most_rows = most_rows or GROUP_ROWS
    if small:
        bound = int((total or 0) * HOT_SHARE)
        cut = F.col(size) > F.lit(bound)
        hot, cold = F.broadcast(groups.where(cut).drop(size)), groups.where(~cut)
        of_hot = rows.join(hot, keys, "inner")
        rest = rows.join(F.broadcast(groups.where(cut).select(*keys)), keys, "left_anti")
        if min(most or 0, bound) <= most_rows:
            return of_hot.unionByName(rest.join(cold.drop(size), keys, how))
        return of_hot.unionByName(_by_slots(rest, cold, keys, size, how, most_rows))
    if (most or 0) <= most_rows:
        return rows.join(groups.drop(size), keys, how)
    return _by_slots(rows, groups, keys, size, how, most_rows)


def _by_slots(rest: DataFrame, cold: DataFrame, keys: list[str], size: str, how: str, most_rows: int) -> DataFrame:
    rows = rest
    bucket, slots, slot = own(rows, "_bucket"), own(rows, "_slots"), own(rows, "_slot")
    at = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    wide = F.broadcast(cold.where(F.col(size) > most_rows).groupBy(at.alias(bucket)).agg(F.max(F.ceil(F.col(size) / most_rows)).alias(slots)))
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.coalesce(slots, F.lit(1)))
    dealt = rest.withColumn(bucket, at).join(wide, bucket, "left").withColumn(slot, spread).drop(bucket, slots)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(slots, F.lit(1)).cast("long") - 1))
    placed = cold.drop(size).withColumn(bucket, at).join(wide, bucket, "left").withColumn(slot, every).drop(bucket, slots)
    return dealt.join(placed, [*keys, slot], how).drop(slot)


def sieve(rows: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with `flag`, false only where `keys` does not hold the row's `key`: so what has to meet the keys can be told from what need not move.

    A bitmap of hashes, of bounded size, goes to all tasks. With more keys than that is made for more rows are flagged. keys has the one column `key` and should be a written table.
    """
    need = -(-keys.count() * BITS_EACH // PART_BITS)
    parts = min(MAX_PARTS, 1 << max(0, need - 1).bit_length())
    part, bits, byte, place = (own(rows, n) for n in ("_part", "_bits", "_byte", "_place"))
    at = F.pmod(F.xxhash64(key), F.lit(parts * PART_BITS))
    spot = (at % PART_BITS).cast("int")
    bitmap = keys.groupBy(F.floor(at / PART_BITS).cast("int").alias(part)).agg(F.bitmap_construct_agg(spot).alias(bits))
    joined = rows.withColumns({part: F.floor(at / PART_BITS).cast("int"), place: spot}).join(F.broadcast(bitmap), part, "left")
    joined = joined.withColumn(byte, F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"))
    held = F.expr(f"shiftright(`{byte}`, `{place}` % 8)").bitwiseAND(F.lit(1)) == 1
    return joined.withColumn(flag, F.coalesce(held, F.lit(False))).drop(part, bits, byte, place)


def drop_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose `key` is in `gone` (one column, a written table); only rows that the sieve flags are shuffled."""
    flag = own(rows, "_flag")
    sifted = sieve(rows, gone, key, flag)
    return sifted.where(~F.col(flag)).drop(flag).unionByName(sifted.where(flag).drop(flag).join(gone, key, "left_anti"))


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a written table with a number for each row, and that column's name: so a row can be decided for itself whatever its id."""
    row = own(df, "_row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), label), row


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any letter case, so that a result may carry them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def column_of(df: DataFrame, name: str) -> Column:
    """A column by its plain name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")
