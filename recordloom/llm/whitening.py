"""Whitening of embeddings: covariance from distinct vectors by their multiplicity, each whitened once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._skew import met
from ._store import importable, saved

#: An entry c becomes the integer floor(STEPS * c) + SHIFT, and has to be below LARGEST.
STEPS, SHIFT, LARGEST = 1024, 100_000, 2.0**50


def vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id and x (the integers as 8 bytes each) of the rows whose vector can be used."""
    importable(df.sparkSession)
    rows = df.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    schema = rows.select("id").schema.add("x", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            entries = lists.flatten().to_numpy(zero_copy_only=False)
            many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(many)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
            kept = np.flatnonzero(bad[ends] == bad[ends - many])
            entries = np.where(np.isfinite(entries), entries, 0.0)
            if np.abs(entries).max(initial=0.0) * STEPS > LARGEST:
                raise ValueError("an entry of a vector is too large")
            x = (np.floor(entries * STEPS).astype(np.int64) + SHIFT).astype("<i8").tobytes()
            ends *= 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array([x[ends[i] - 8 * many[i] : ends[i]] for i in kept], pa.binary())], names=["id", "x"])

    return rows.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of the column x as rows, all of one length."""
    return np.array([np.frombuffer(b.as_buffer(), "<i8") for b in batch.column("x")])


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """How many vectors are fitted, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.array([len(b.as_buffer()) // 8 for b in batch.column("x")])
            for d in np.unique(size):
                own = batch.filter(pa.array(size == d))
                part = own.column("weight").to_numpy() @ _matrix(own)
                total[d] = total[d] + part if d in total else part
        for d, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(s)], names=["size", "i", "s"])

    n = distinct.agg(F.sum("weight")).first()[0] or 0
    got = distinct.select("x", "weight").mapInArrow(run, "size long, i long, s long").groupBy("size", "i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).orderBy("size", "i").collect()
    sizes = {r[0] for r in got}
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    return n, [int(r[2]) for r in got]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n*x - S) / n, exact up to the division where n*x fits in a long."""
    return (n * x - sums) / n


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Of the fitted vectors, divisor n: a weighted product of centred matrices in each task, added up entry by entry."""
    d, total = len(sums), np.array(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, some = np.zeros((d, d)), False
        for batch in batches:
            some |= len(batch) > 0
            if len(batch):
                x = _centred(_matrix(batch), n, total)
                part += x.T @ (x * batch.column("weight").to_numpy()[:, None])
        if some:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(part[i, j])], names=["i", "j", "v"])

    got = distinct.select("x", "weight").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    out = np.zeros((d, d))
    for i, j, v in got:
        out[i, j] = out[j, i] = v / n
    return out


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; those that rounding can't tell from 0 are left out."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    some = e > max(e[0], 0.0) * len(v) * np.finfo(float).eps if len(e) else np.zeros(0, bool)
    return e[some], u[:, some]


def _whitened(distinct: DataFrame, n: int, sums: list[int], e: np.ndarray, u: np.ndarray) -> DataFrame:
    """key, times, weight, deviation and z of each distinct vector."""
    importable(distinct.sparkSession)
    total, turn = np.array(sums), u / np.sqrt(e)
    schema = distinct.select("key", "times", "weight").schema.add("deviation", "string", False).add("z", T.ArrayType(T.DoubleType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch)
            apart = n * x - total
            if float(np.abs(apart).max()) ** 2 * len(total) < 2.0**62:
                deviation = (apart * apart).sum(axis=1)
            else:  # Python's integers, where the sum of squares needs more than a long
                deviation = (apart.astype(object) ** 2).sum(axis=1)
            z = (apart / n) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "times", "weight")), pa.array([str(v) for v in deviation]), lists], names=schema.names)

    return distinct.select("key", "times", "weight", "x").mapInArrow(run, schema)


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest entry of the whitened vectors' covariance (centred first, divisor n) less the identity."""
    if not k:
        return 0.0
    z = [F.col("z")[i] for i in range(k)]
    means = white.agg(*(F.sum(F.col("weight") * c) / n for c in z)).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*(F.sum(F.col("weight") * (z[i] - means[i]) * (z[j] - means[j])) / n for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, got, strict=True))


def whitened(df: DataFrame, row_id: str, vector: str, components: int = 8, by_count: bool = True) -> DataFrame:
    """row_id, component (from 1), n, deviation, whitened, explained and identity_error of each usable row and component.

    Entries become integers x = floor(1024*c) + 100000. Rows of equal x are one vector that counts as often as it
    occurs (by_count) or once; the fit has n vectors with sums S, and covariance V with divisor n. Components
    are V's eigenvectors by falling eigenvalue e; whitened is x - S/n on the component over sqrt(e), explained
    e over V's trace. deviation, a decimal, is the exact sum of (n*x - S)^2 over the dimensions.

    Each distinct vector is whitened once and joined back by a 128-bit hash of it; vectors that a thousandth of all rows share
    are sent to their rows, so that no task gets all copies of a vector. Sums and covariances are added up in
    tasks; the driver gets one number per dimension and per pair of dimensions.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped; ids may be null or
    repeated, each row being answered for itself; an empty table, and one whose vectors are all equal (it has no component
    of positive variance), give no rows. Vectors of several lengths and entries beyond 2^40 are refused, as is an id
    column named like a new one; other columns of df are not looked at.
    """
    if row_id in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        raise ValueError(f"the id column is named like a new column: {row_id}")
    found = vectors(df, row_id, vector)
    key = F.unhex(F.md5("x")).alias("key")
    distinct = found.groupBy("x").agg(F.count("*").alias("times"))
    weight = F.col("times") if by_count else F.lit(1).cast("long")
    distinct = saved(distinct.select(key, "x", "times", weight.alias("weight")))
    rows = saved(found.select("id", key))
    n, sums = _sums(distinct)
    v = _covariance(distinct, n, sums)
    e, u = principal(v, components)
    white = saved(_whitened(distinct, n, sums, e, u))
    error = _identity_error(white, n, len(e))
    share = F.array(*(F.lit(float(x / np.trace(v))) for x in e)) if len(e) else F.array().cast("array<double>")
    each = met(rows, white.select("key", "deviation", "z"), ["key"]).select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(row_id), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
