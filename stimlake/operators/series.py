"""Ordered operations on time series that never sort a whole series in one task.

A plain window over a series puts all of it into one task, which a hot series (one that holds a third of all
rows) would break. Here a series is cut into cells of equal time; a window works inside each cell, and what
must pass from cell to cell (the last row, a count, a sum) travels through a table with one row for each
cell. The cell table is joined on the window's own keys, so it costs no further shuffle of the rows.

Rows whose key or order column is null take no part in these operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stimlake.tables import cut, maybe_broadcast, parts

CELL = "_cell"


def _celled(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float) -> DataFrame:
    ok = F.lit(True)
    for c in (*keys, *order):
        ok = ok & F.col(c).isNotNull()
    return df.filter(ok).withColumn(CELL, F.floor(F.col(order[0]) / width))


def _inside(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, CELL).orderBy(*order)


def _between(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CELL)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: float) -> DataFrame:
    """Add ``prev_<column>`` of the row before in the series, null for the first."""
    rows = _celled(df, keys, order, width)
    tails = rows.groupBy(*keys, CELL).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"))
    tails = tails.select(*keys, CELL, F.lag("_tail").over(_between(keys)).alias("_tail"))
    w = _inside(keys, order)
    rows = rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {"_at": F.row_number().over(w)}).join(tails, [*keys, CELL])
    return rows.withColumns({f"prev_{c}": F.when(F.col("_at") == 1, F.col("_tail")[c]).otherwise(F.col(f"prev_{c}")) for c in columns}).drop("_at", "_tail", CELL)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], width: float) -> DataFrame:
    """Add ``next_<column>`` of the row after in the series, null for the last."""
    rows = _celled(df, keys, order, width)
    heads = rows.groupBy(*keys, CELL).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_head"))
    heads = heads.select(*keys, CELL, F.lead("_head").over(_between(keys)).alias("_head"))
    w = _inside(keys, order)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"_last": F.lead(F.lit(1)).over(w)}).join(heads, [*keys, CELL])
    return rows.withColumns({f"next_{c}": F.when(F.col("_last").isNull(), F.col("_head")[c]).otherwise(F.col(f"next_{c}")) for c in columns}).drop("_last", "_head", CELL)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, width: float, name: str) -> DataFrame:
    """Add the sum of ``value`` over the series up to and including each row."""
    rows = _celled(df, keys, order, width).withColumn("_v", value)
    sums = rows.groupBy(*keys, CELL).agg(F.sum("_v").alias("_sum"))
    before = F.sum("_sum").over(_between(keys).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, CELL, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_v").over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, own).join(sums, [*keys, CELL]).withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_before", CELL)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: float, name: str = "nth") -> DataFrame:
    """Add the place of each row in its series, from 0."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), width, name).withColumn(name, F.col(name) - 1)


def running_total(df: DataFrame, order: str, value: Column, name: str, rows: int = 200_000) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and including each one, by a unique ``order``.

    Rows are shuffled into ranges of about ``rows``, written down with the number of their range; the sums of the
    ranges (one row each) say what came before. Null orders are left out.
    """
    ok = df.filter(F.col(order).isNotNull()).withColumn("_v", value)
    n = parts(ok.count(), rows)
    placed = cut(ok.repartitionByRange(n, order).withColumn(CELL, F.spark_partition_id()), "ranges")
    before = F.sum("_sum").over(Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1))
    sums = placed.groupBy(CELL).agg(F.sum("_v").alias("_sum")).select(CELL, F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy(CELL).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn(name, own).join(maybe_broadcast(sums), CELL).withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_before", CELL)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, take: Sequence[str], width: float, *, forward: bool = False, strict: bool = False) -> DataFrame:
    """Join each left row with the last right row at or before it (or the first at or after it).

    strict leaves out right rows at the same time. The columns ``take`` of the right row are added, null
    without a partner. Of right rows at one time the one with the greatest (forward: least) ``take`` counts.
    """
    sign = -1.0 if forward else 1.0
    cols = left.columns
    named = [f"r_{i}" for i in range(len(take))]
    rhs = F.struct(*[F.col(c).alias(n) for n, c in zip(named, take)])
    lw = left.withColumn("_l", F.struct(*cols)).withColumn("_r", F.lit(None).cast(_struct(right, take, named)))
    rw = right.withColumn("_l", F.lit(None).cast(_struct(left, cols, cols))).withColumn("_r", rhs)
    pick = [*[F.col(k) for k in keys], (F.col(t) * sign).alias("_t"), "_l", "_r"]
    side = F.when(F.col("_l").isNotNull(), 0 if strict else 1).otherwise(1 if strict else 0)
    both = lw.select(*pick).unionByName(rw.select(*pick)).withColumn("_side", side)
    order = ["_t", "_side", "_r"] if not forward else ["_t", "_side", "_tie"]
    if forward:  # of equal times the least comes last
        both = both.withColumn("_tie", F.struct(*[-F.col(f"_r.r_{i}") for i in range(len(take))]) if all(_numeric(right, c) for c in take) else F.col("_r"))
    rows = both.filter(F.col("_t").isNotNull()).withColumn(CELL, F.floor(F.col("_t") / width))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    w = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = rows.filter(F.col("_r").isNotNull()).groupBy(*keys, CELL).agg(F.max_by("_r", F.struct(*order)).alias("_tail"))
    cells = rows.select(*keys, CELL).distinct().join(tails, [*keys, CELL], "left")
    carried = cells.select(*keys, CELL, F.last("_tail", ignorenulls=True).over(_between(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_tail"))
    got = rows.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull()).join(carried, [*keys, CELL])
    best = F.coalesce(F.col("_r"), F.col("_tail"))
    return got.select(*[F.col("_l")[c].alias(c) for c in cols], *[best[f"r_{i}"].alias(c) for i, c in enumerate(take)])


def _struct(df: DataFrame, cols: Sequence[str], names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, cols)])


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)
