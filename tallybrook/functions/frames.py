"""Frame helpers: null-safe attachment by grouping columns, durable intermediates."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

By = Sequence[str]
KEY_BLOCKS = 1 << 19  # rows of 64 bits in the broadcast table of ``likely``
BUSY = 1000  # a key that more than one in so many rows share is busy


def attach(left: DataFrame, right: DataFrame, keys: By) -> DataFrame:
    """Left join on ``keys`` where ``right`` holds at most one row per key value.

    Null keys match null keys.  Without keys ``right`` is a one-row aggregate and
    becomes a scalar subquery, so no join is planned at all.
    """
    extra = [c for c in right.columns if c not in keys]
    if not keys:
        row = right.select(F.struct(*extra).alias("_row")).scalar()
        return left.withColumn("_row", row).select(
            *left.columns, *[F.col("_row").getField(c).alias(c) for c in extra]
        )
    return match(left, right, keys, "left")


def match(left: DataFrame, right: DataFrame, keys: By, how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys``; the result carries the left side's keys."""
    extra = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *extra)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def likely(rows: DataFrame, key: str, others: DataFrame, other_key: str, blocks: int = KEY_BLOCKS) -> DataFrame:
    """``rows`` without most of those that find no partner in ``others``; none with a partner is lost.

    For a join of a large table with a small part of another one: only the rows left here are
    shuffled.  Whole-number keys are hashed to bits, 64 in each of at most ``blocks`` rows, so the
    broadcast table has a bounded size.  Keys that share a bit pass, and the join drops them.
    """

    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("bigint")), F.lit(64 * blocks))

    block, bit = (lambda c: F.shiftright(c, 6)), (lambda c: F.pmod(c, F.lit(64)).cast("int"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col("_place")))
    seen = others.select(place(other_key).alias("_place")).groupBy(block(F.col("_place")).alias("_block")).agg(F.bit_or(one).alias("_bits"))
    met = (block(place(key)) == F.col("_block")) & (F.getbit("_bits", bit(place(key))) == 1)
    return rows.join(F.broadcast(seen), met, "left_semi")


def group_window(by: By) -> WindowSpec:
    """Window over the rows of one ``by`` group.

    Only for frames whose groups are bounded by construction: months, periods,
    checks, slices.  Customer, order and product rows go through ``ordering``.
    """
    return Window.partitionBy(*(by or [F.lit(0)]))


def numbered(df: DataFrame, keys: By) -> tuple[DataFrame, list[str]]:
    """``df`` with a number made of ``keys`` in front of them, and the keys to group and order by.

    For windows over customers, products or the like, of which there are many: rows are sorted by
    the number, so that most of them need no comparison of texts.  Grouping by the same keys
    afterwards needs no shuffle.
    """
    return df.withColumn("_number", F.xxhash64(*keys)), ["_number", *keys]


def by_key(rows: DataFrame, keys: By, step: Callable[[DataFrame], DataFrame], busy: int = BUSY) -> DataFrame:
    """``step`` on rows that are brought together by ``keys`` before it, so that what it groups by
    these and further columns is shuffled once and not for each grouping.

    Rows of busy keys, which would fill a task, are left for ``step`` to combine before it shuffles
    them.  A sketch names these keys: results are the same whichever it names.  ``rows`` are
    read several times and should be written ones.
    """
    key = F.xxhash64(*keys)
    counted = rows.select(key.alias("_key")).agg(F.expr(f"approx_top_k(_key, {busy}, {16 * busy})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    often = [k["item"] for k in counted["top"] or [] if k["count"] * busy > counted["n"]]
    if not often:
        return step(rows.repartition(*keys))
    return step(rows.filter(~key.isin(often)).repartition(*keys)).unionByName(step(rows.filter(key.isin(often))))


def gather(parts: Sequence[DataFrame], by: By) -> DataFrame:
    """One wide row per store from frames with at most one row per store.

    The parts are stacked and folded by one small aggregation: every part runs once
    and side by side, without a chain of joins.
    """
    kinds = [(f.name, f.dataType, i) for i, part in enumerate(parts) for f in part.schema if f.name not in by]

    def padded(part: DataFrame, i: int) -> DataFrame:
        columns = [F.col(f"`{n}`") if j == i else F.lit(None).cast(t).alias(n) for n, t, j in kinds]
        return part.select(*by, *columns)

    layers = [padded(part, i) for i, part in enumerate(parts)]
    while len(layers) > 1:  # pairwise, so that no plan is analysed again and again
        layers = [a.union(b) for a, b in zip(layers[::2], layers[1::2])] + layers[len(layers) // 2 * 2 :]
    stacked = layers[0]
    return stacked.groupBy(*by).agg(*[F.expr(f"first(`{n}`, true) as `{n}`") for n, _, _ in kinds])


def _name_folder(spark: SparkSession) -> None:
    """See that the session has a checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session that runs on one
    machine may have none; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tallybrook-")
        sc.setCheckpointDir(named)


# Spark's own setting, off by default: a query's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _freeing = threading.Lock(), {}  # by session: how many blocks are open, and its former setting


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that start in this block remove their shuffle files when they end.

    Else these files lie on the executors' disks until the driver collects its garbage.  What is
    written here is read from the written copy; a query run once more is computed once more.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        count, former = _freeing.get(session, (0, spark.conf.get(FREED, "false")))
        _freeing[session] = (count + 1, former)
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _lock:
            count, former = _freeing.pop(session)
            if count > 1:
                _freeing[session] = (count - 1, former)
            else:
                spark.conf.set(FREED, former)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    _name_folder(SparkSession.getActiveSession() or df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``durable`` for many rows that are read more than once: compressed, and read by column.

    The files stay in the checkpoint folder for its owner to empty.
    """
    spark = SparkSession.getActiveSession() or df.sparkSession
    _name_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    typed = [F.col(f"`{n}`").cast("string").alias(n) if k == "void" else F.col(f"`{n}`") for n, k in df.dtypes]  # files have no void
    whole = df.select(*typed)
    with shuffles_freed(spark):
        whole.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(whole.schema).parquet(path)


def side_by_side(tasks: Sequence[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Build and write several independent small results as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        return list(pool.map(lambda task: durable(task()), tasks))


def _has_floats(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_floats(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, MapType):
        return _has_floats(kind.valueType)
    return isinstance(kind, (DoubleType, FloatType))


def finite(c: Column, kind: DataType) -> Column:
    """``c`` with null for NaN and infinity, also in the fields and elements it holds.

    The schema tells where floats are; everything else is left as it is.
    """
    if not _has_floats(kind):
        return c
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, x: finite(x, kind.valueType))
    return F.when(F.abs(c) < float("inf"), c)  # not so for NaN, which is above infinity


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with ``finite`` columns, however deep."""
    return df.select(*[finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def settle(df: DataFrame, digits: int = 6) -> DataFrame:
    """Output form: decimals as double, doubles rounded, no negative zero, no NaN."""

    def out(name: str, kind: str):
        if kind.startswith("decimal") or kind in ("double", "float"):
            c = F.round(F.col(f"`{name}`").cast("double"), digits) + F.lit(0.0)
            return F.nanvl(c, F.lit(None).cast("double")).alias(name)
        return F.col(f"`{name}`")

    return df.select(*[out(n, k) for n, k in df.dtypes])
