"""Running values over long ordered groups.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task. Here
the rows are range-partitioned by key *and* order, so a hot key is spread over many
tasks; each task computes its running values locally and one small row per
(key, task) carries the value on to the next task. At most one key continues over a
task border, so the carried table never has more rows than there are tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scanloom.session import cut_lineage

PART = "_part"
POS = "_pos"


def spread_in_order(df: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """Stamp every row with its task (``_part``) and its position in the global order (``_pos``).

    The stamps depend on the sampled range borders, hence the lineage cut: a lost
    executor must not see other borders than the rest of the job.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stamped = (
        df.repartitionByRange(n, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return cut_lineage(stamped)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in names])


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,  # skips NULL
    "min": F.least,
}
_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(spread: DataFrame, keys: list[str], earlier: bool = False, **values: tuple[str, Column]) -> DataFrame:
    """Add running ``sum``, ``max`` or ``min`` columns along the stamped order.

    ``values`` maps a new column to ``(kind, expression)``. With ``earlier`` the
    current row is left out. Needs numeric (or, for max/min, any orderable) values.
    """
    work = spread
    for name, (_, col) in values.items():
        work = work.withColumn(f"_v_{name}", col)
    local = Window.partitionBy(*keys, PART).orderBy(POS).rowsBetween(
        Window.unboundedPreceding, -1 if earlier else Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)

    totals = work.groupBy(*keys, PART).agg(
        *[_AGGREGATE[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items()])
    carried = totals.select(
        *keys, PART, F.min(PART).over(Window.partitionBy(*keys)).alias("_first"),
        *[_AGGREGATE[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()],
    ).where(F.col(PART) > F.col("_first")).drop("_first")

    out = work.select("*", *[_AGGREGATE[kind](f"_v_{name}").over(local).alias(f"_l_{name}")
                             for name, (kind, _) in values.items()])
    joined = out.join(F.broadcast(carried), _same(out, carried, [*keys, PART]), "left")
    return joined.select(
        *[out[c] for c in spread.columns],
        *[_COMBINE[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")).alias(name)
          for name, (kind, _) in values.items()],
    )


def previous(spread: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
    """``lag(value)`` along the stamped order; the value may be a struct, NULL marks the first row."""
    work = spread.withColumn("_v", F.struct(value.alias("value")))
    local = Window.partitionBy(*keys, PART).orderBy(POS)
    totals = work.groupBy(*keys, PART).agg(F.max_by("_v", POS).alias("_t"))
    by_part = Window.partitionBy(*keys).orderBy(PART)
    carried = totals.select(*keys, PART, F.lag("_t").over(by_part).alias("_c")).where(F.col("_c").isNotNull())
    out = work.withColumn("_l", F.lag("_v").over(local))
    joined = out.join(F.broadcast(carried), _same(out, carried, [*keys, PART]), "left")
    return joined.select(
        *[out[c] for c in spread.columns],
        F.coalesce(F.col("_l"), F.col("_c"))["value"].alias(name),
    )


def numbered(spread: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``row_number()`` along the stamped order."""
    return running(spread, keys, **{name: ("sum", F.lit(1).cast("bigint"))})


def drop_stamps(df: DataFrame) -> DataFrame:
    return df.drop(PART, POS)


HOT_ROWS = 1_000_000
MOST_HOT_KEYS = 10_000
#: Slots of keys that are counted together to find hot ones: a count for each key would be held in memory by every task.
HOT_SLOTS = 1 << 16
#: Rows that a task gets where rows are dealt by key, so its memory does not grow with the table.
ROWS_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def spread_join(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join a large side with hot keys to a side that has one row per key.

    Keys are counted in ``HOT_SLOTS`` slots. Those of slots with more than ``hot_rows`` rows (or a ten-thousandth of
    all rows, if that is more) are split into buckets by the ``by`` columns, and only their small-side rows are
    repeated. That threshold leaves at most ``MOST_HOT_KEYS`` hot slots, so their table may be broadcast. ``large`` is
    read twice: pass a stored table. Its rows are dealt once, ``ROWS_A_TASK`` a task.
    """
    return salted_join(large, small, on, by, how, hot_rows).drop("_salt")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """``spread_join`` that keeps ``_salt``: rows that agree in ``on`` and ``_salt`` are in one task, and those that agree in ``on`` and ``by`` have one salt."""
    spark, slot = large.sparkSession, F.pmod(F.xxhash64(*on), F.lit(HOT_SLOTS)).cast("int")
    counts = [tuple(r) for r in large.groupBy(slot.alias("_slot")).agg(F.count("*").alias("_n")).collect()]  # numbers, at most ``HOT_SLOTS`` rows
    rows = sum(n for _, n in counts)
    limit = max(hot_rows, rows / MOST_HOT_KEYS)
    hot = [(s, int(-(-n // limit))) for s, n in counts if n > limit]
    if not hot:  # the common case: no table to build and to meet, one salt
        n = tasks_for(spark, rows)
        alone = lambda side: side.withColumn("_salt", F.lit(0))
        return alone(large.repartition(n, *on)).join(alone(small.repartition(n, *on)).drop("_salt"), on, how)
    table = F.broadcast(spark.createDataFrame(hot, "_slot int, _b int"))
    buckets = F.coalesce("_b", F.lit(1))
    salted = large.withColumn("_slot", slot).join(table, "_slot", "left").withColumn("_salt", F.pmod(F.xxhash64(*by), buckets).cast("int")).drop("_b", "_slot")
    repeated = small.withColumn("_slot", slot).join(table, "_slot", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), buckets - 1))).drop("_b", "_slot")
    n = tasks_for(spark, rows)
    return salted.repartition(n, *on, "_salt").join(repeated.repartition(n, *on, "_salt"), [*on, "_salt"], how)
