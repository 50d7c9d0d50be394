"""Matching records of two tables by nearest time: union, sort, carry the last and the next right-side row.

Both sides are united and sorted per entity and time inside cells of ``cell`` time units. The last
right-side row at or before each left row and the next one at or after it are carried onto it by two window
functions, and the nearer one within the tolerance is kept.

How it is spread: the window's partitions are (entity, cell), not entities, so a hot entity is spread over
its cells. Right rows within the tolerance of a cell's border are also put into the neighbouring cell; no
pair is lost, because a partner is never farther than the tolerance. One shuffle, all of it in the JVM. For
rows denser than usual, take a smaller ``cell``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stimlake.tables import maybe_broadcast, usable


def match_nearest(left: DataFrame, rights: dict[str, DataFrame], tolerance: DataFrame, *, cell: float = 20.0) -> DataFrame:
    """Give each left row the nearest row of each right table.

    left and each of rights: ``entity, id`` BIGINT and ``t`` DOUBLE; tolerance: ``entity`` and ``tol`` DOUBLE,
    one row for each entity (the least, if there are more). Other columns are ignored.

    Result: ``id, kind, ref_id, dt`` (the right row's time less the left row's), one row for each left id and
    right table with a partner strictly nearer than the entity's tolerance. Of two equally near rows the
    earlier one wins, of rows at one time the one with the smallest id.

    Rows whose entity, id or t is null, or whose t is NaN or infinite, take no part, nor do entities without
    a positive tolerance. An entity's cells of time are ``cell`` seconds long, or two tolerances where that is more.
    Repeated rows of an id count once. Empty tables give an empty result.
    """
    fine = usable("t") & F.col("entity").isNotNull() & F.col("id").isNotNull() & (F.abs("t") < 1e15)
    tol = tolerance.groupBy(F.col("entity").cast("long").alias("entity")).agg(F.min("tol").alias("tol")).filter("tol > 0 AND tol < 1e15")
    tol = maybe_broadcast(tol)

    def side(df: DataFrame, kind: str) -> DataFrame:
        rows = df.select(F.col("entity").cast("long"), F.col("id").cast("long"), F.col("t").cast("double")).filter(fine).join(tol, "entity")
        at = lambda x: F.floor(x / F.greatest(F.lit(float(cell)), 2 * F.col("tol")))
        cells = F.array(at(F.col("t"))) if not kind else F.array_distinct(F.array(at(F.col("t") - F.col("tol")), at(F.col("t")), at(F.col("t") + F.col("tol"))))
        return rows.select("entity", "id", "t", "tol", F.lit(kind).alias("kind"), F.explode(cells).alias("cell"))

    rows = side(left, "")
    for kind, df in rights.items():
        rows = rows.unionByName(side(df, kind))
    by = Window.partitionBy("entity", "cell")
    up = by.orderBy("t", "is_left", F.col("id").desc())
    down = by.orderBy(F.col("t").desc(), F.col("is_left"), F.col("id").desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("is_left", (F.col("kind") == "").cast("int"))

    def own(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.struct("t", "id"))

    last = [F.last(own(k), ignorenulls=True).over(up.rowsBetween(*so_far)).alias(f"last_{i}") for i, k in enumerate(rights)]
    following = [F.last(own(k), ignorenulls=True).over(down.rowsBetween(*so_far)).alias(f"next_{i}") for i, k in enumerate(rights)]
    wide = rows.select("*", *last, *following, F.lag("id").over(down).alias("before"), F.lag("is_left").over(down).alias("before_left"))
    again = (F.col("before_left") == 1) & (F.col("before") == F.col("id"))
    found = []
    for i, kind in enumerate(rights):
        sides = [(F.col("t") - F.col(f"last_{i}")["t"], F.col(f"last_{i}")), (F.col(f"next_{i}")["t"] - F.col("t"), F.col(f"next_{i}"))]
        options = F.array(*[F.struct(gap.alias("gap"), row["t"].alias("at"), row["id"].alias("id")) for gap, row in sides])
        best = F.array_min(F.filter(options, lambda o: o["gap"].isNotNull() & (o["gap"] < F.col("tol"))))
        found.append(F.when(best.isNotNull(), F.struct(F.lit(kind).alias("kind"), best["id"].alias("ref_id"), (best["at"] - F.col("t")).alias("dt"))))
    got = wide.filter((F.col("is_left") == 1) & ~F.coalesce(again, F.lit(False))).select("id", F.inline(F.array_compact(F.array(*found))))
    return got
