"""Reading and writing: array files, array stores turned tables, logs, caches."""

from __future__ import annotations

import ast
import os
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 65_536


def npy_header(path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """Type, shape, order and offset of the data of an .npy file; pickled objects are refused."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"{path} is no .npy file")
        major = f.read(2)[0]
        size = struct.unpack("<H" if major == 1 else "<I", f.read(2 if major == 1 else 4))[0]
        h = ast.literal_eval(f.read(size).decode("latin1" if major < 3 else "utf8"))
        dtype = np.dtype(h["descr"])
        if dtype.hasobject:
            raise ValueError(f"{path} holds pickled objects, which are not read")
        return dtype, tuple(h["shape"]), bool(h["fortran_order"]), f.tell()


class _Rows(InputPartition):
    def __init__(self, first: int, n: int):
        self.first, self.n = first, n


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int, first: int, end: int | None):
        self.path, self.rows, self.first, self.end = path, rows, first, end

    def partitions(self):
        _, shape, fortran, _ = npy_header(self.path)
        if fortran and len(shape) > 1:
            raise ValueError(f"{self.path} is in column order; write it in row order first")
        n = shape[0] if shape else 1
        first, end, _ = slice(self.first, self.end).indices(n)
        return [_Rows(a, min(self.rows, end - a)) for a in range(first, end, self.rows)] or [_Rows(0, 0)]

    def read(self, p):
        dtype, shape, _, offset = npy_header(self.path)
        width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
        with open(self.path, "rb") as f:
            f.seek(offset + p.first * width * dtype.itemsize)
            a = np.frombuffer(f.read(p.n * width * dtype.itemsize), dtype).reshape(p.n, width)
        for i, row in enumerate(a):
            yield p.first + i, [float(x) for x in row]


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: one row for each place on the first axis: ``i, values``.

    Values are the other axes in C-order, as doubles. Each partition seeks to its own rows, so nobody reads the
    whole file; it must lie where all executors see it. The options ``first`` and ``end`` (as in a slice) leave out rows
    before they are read.
    """

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "i long, values array<double>"

    def reader(self, schema):
        o = self.options
        return _NpyReader(o["path"], int(o.get("rows", ROWS_PER_PARTITION)), int(o.get("first", 0)), int(o["end"]) if o.get("end") else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def load_array(spark: SparkSession, path: str, *, missing_ok: bool = False, rows: tuple[int, int] | None = None) -> DataFrame | None:
    """An array as a table: a parquet sibling of the path if there is one, else the .npy file itself.

    rows: only those places of the first axis, begin and end; of a table the filter on ``i`` goes to its scan, of a file
    the others are never read.
    """
    stem = os.path.splitext(path)[0]
    for candidate in dict.fromkeys((path if path.endswith(".parquet") else f"{stem}.parquet", path)):
        if os.path.exists(candidate):
            if candidate.endswith(".parquet"):
                df = spark.read.parquet(candidate)
                return df if rows is None else df.filter((F.col("i") >= rows[0]) & (F.col("i") < rows[1]))
            register(spark)
            part = {} if rows is None else {"first": str(rows[0]), "end": str(max(rows))}
            return spark.read.format("npy").options(**part).load(candidate)
    if missing_ok:
        return None
    raise FileNotFoundError(path)


def save_results(results: dict[str, DataFrame], path: str) -> None:
    """Write the tables of an analysis (fields, peaks, fits, scores) under one folder, each by its name."""
    for name, df in results.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(path, f"{name}.parquet"))


def load_results(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables that save_results wrote."""
    return {n: spark.read.parquet(os.path.join(path, f"{n}.parquet")) for n in names}


def resolve(name: str, roots: list[str]) -> str:
    """The first of the roots' files of that name."""
    for r in roots:
        if os.path.exists(p := os.path.join(r, name)):
            return p
    raise FileNotFoundError(f"{name} is under none of {roots}")


def write_by(df: DataFrame, path: str, *keys: str, rows_per_file: int = 1_000_000) -> None:
    """Write a table for reads by key: partitioned by the keys, zstd, files of bounded length."""
    df.write.mode("overwrite").partitionBy(*keys).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at the path, built and written there first if its writing never ended."""
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text logs: ``file, at, line`` with at the place of the line in its file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("lines"))
    return whole.select("file", F.posexplode("lines").alias("at", "line"))


def check_spikes(spikes: DataFrame, neurons: DataFrame) -> None:
    """Refuse responses that lack a column, or have neurons without a position."""
    if lacking := {"neuron", "trial", "frame", "value"} - set(spikes.columns):
        raise ValueError(f"responses lack {sorted(lacking)}")
    if spikes.select("neuron").distinct().join(neurons, "neuron", "left_anti").limit(1).count():
        raise ValueError("there are responses of neurons without a position")


def frames_from_rows(pdf: pd.DataFrame) -> np.ndarray:
    """Arrays of a bounded result as a matrix, for tests and notebooks."""
    return np.array(pdf["values"].tolist())
