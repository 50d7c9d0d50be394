"""Protocols, logs and trial bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_sessions(lines: DataFrame, subject: str, order: str, line: str) -> DataFrame:
    """Experiment records from log lines.

    A line with 'Starting Series' opens a record (its words 2, 6 and 8 are start, date and number), one with
    'Completed' closes it (word 2 is the end), 'Loaded parameter file' names the parameter file for those that
    follow, 'Interrupted' is kept in the record's log. A record that is still open when the next one starts is
    dropped; one open at the end of the log stays, with end and dur -1. overall_id counts the completed records
    before it. The log of one subject is one group: its length is that of a text file written by hand.

    Result: subject, ``overall_id, date, num, pfile, start, end, dur, log``; dur is in seconds.
    """
    w = Window.partitionBy(subject).orderBy(order)
    word = lambda i: F.get(F.split(F.col(line), " "), i)
    x = lines.filter(F.col(line).isNotNull()).withColumn(
        "kind", F.when(F.col(line).contains("Loaded parameter file"), "file").when(F.col(line).contains("Starting Series"), "start").when(F.col(line).contains("Completed"), "end").when(F.col(line).contains("Interrupted"), "stop")
    ).filter("kind IS NOT NULL")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pfile = F.element_at(F.split(F.col(line), r"\\"), -1)
    x = x.withColumns({"run": F.count(F.when(F.col("kind") == "start", 1)).over(so_far), "pfile": F.coalesce(F.last(F.when(F.col("kind") == "file", pfile), True).over(so_far), F.lit(""))})
    first = x.filter("kind = 'start'").select(subject, "run", "pfile", word(1).alias("start"), word(5).alias("date"), word(7).alias("num"))
    rest = x.filter("run > 0").groupBy(subject, "run").agg(F.max_by(F.when(F.col("kind") == "end", word(1)), F.when(F.col("kind") == "end", F.col(order))).alias("end"), F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "stop", F.struct(order, line)))), lambda e: e[line]).alias("log"))
    s = first.join(rest, [subject, "run"])
    s = s.withColumn("later", F.lead(F.lit(1)).over(Window.partitionBy(subject).orderBy("run"))).filter("end IS NOT NULL OR later IS NULL")
    done = F.count("end").over(Window.partitionBy(subject).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    seconds = F.unix_timestamp(F.try_to_timestamp("end", F.lit("HH:mm"))) - F.unix_timestamp(F.try_to_timestamp("start", F.lit("HH:mm")))
    return s.select(subject, done.alias("overall_id"), "date", "num", "pfile", "start", F.coalesce("end", F.lit("-1")).alias("end"), F.coalesce(seconds, F.lit(-1)).alias("dur"), "log")


def invert_sequence(rows: DataFrame, keys: Sequence[str], stim: str, positions: str) -> DataFrame:
    """Presentation order from the positions of each stimulus: keys, ``position``, stim, ``repeat`` (from 0)."""
    return rows.select(*keys, stim, F.posexplode(positions).alias("repeat", "position")).filter("position IS NOT NULL")


def first_repeats(rows: DataFrame, stim: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n repeats of each stimulus; stimuli with fewer are left out. Adds ``repeat`` from 1."""
    r = F.row_number().over(Window.partitionBy(stim).orderBy(*order))  # Spark limits each map side to n a stimulus
    top = rows.withColumn("repeat", r).filter(F.col("repeat") <= n)
    enough = rows.groupBy(stim).agg(F.count("*").alias("k")).filter(F.col("k") >= n).select(stim)
    return top.join(enough, stim, "left_semi")


def group_means(rows: DataFrame, keys: Sequence[str], value: str, exclude: Column | None = None) -> DataFrame:
    """Mean response of each combination of the keys, without excluded rows."""
    return (rows.filter(~exclude) if exclude is not None else rows).groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def sweep(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Every combination of parameter values, numbered as nested loops would: ``run`` and one column an axis."""
    df = spark.range(1).select(F.lit(0).alias("run"))
    for name, values in axes.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name)).withColumn("run", F.col("run") * len(values) + F.col("_i")).drop("_i")
    return df


def split_rows(rows: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Give each row one of several sets by a hash of its key: ``part``. The same key always gets the same set."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    total, upto, part = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share / total
        part = F.when(u < upto, name) if part is None else part.when(u < upto, name)
    return rows.withColumn("part", F.coalesce(part, F.lit(list(shares)[-1])))


def split_words(text: str | Column, n: int) -> list[Column]:
    """The n numbers after a message's first word, null where there is none."""
    c = F.split(F.col(text) if isinstance(text, str) else text, " ")
    return [F.get(c, i + 1).try_cast("double").alias(f"v{i}") for i in range(n)]


def signed_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle in degrees from one plane vector to another, signed by their determinant; an error for a zero vector."""
    na, nb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cos = F.greatest(F.least((ax * bx + ay * by) / (na * nb), F.lit(1.0)), F.lit(-1.0))
    angle = F.degrees(F.acos(cos)) * F.when(ax * by - ay * bx < 0, -1).otherwise(1)
    return F.when((na == 0) | (nb == 0), F.raise_error(F.lit("a zero vector has no angle")).cast("double")).otherwise(angle)
