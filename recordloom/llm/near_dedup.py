"""Near-duplicate documents: fast similarity sketches, banding, and exact verification on full shingle sets."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import importable, saved, small
from ._words import LOWER, NOT_SPACE, Rolling, doc_of, joined, mix, pieces, spans
from ._words import U as U64
from .graph import linked, with_components

#: 36 bands of 4 coordinates: documents at the least similarity of 0.75 share none with odds of one in a million.
BANDS, ROWS = 36, 4
#: Two bits of every coordinate, 32 coordinates a long: what tells most unlike pairs apart before full sets are read.
BITS = [f"s{i}" for i in range(-(-BANDS * ROWS // 32))]
WORDS = 5
_ODD = U64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-word shingles of each text, sorted within the text, and where each text's begin."""
    data, at = joined(column)
    texts = len(at) - 1
    data = LOWER[data]
    start, end = spans(NOT_SPACE[data])
    begins = np.zeros(texts + 1, np.int64)
    if not len(start):
        return np.zeros(0, U64), begins
    doc = doc_of(start, at)
    word = Rolling(data).of(start, end)
    per = np.bincount(doc, minlength=texts)
    first = np.cumsum(per) - per
    # n words each, or all words of a text that has fewer
    gram = word.copy()
    index = np.arange(len(word))
    whole = np.minimum(per, n)[doc]
    for k in range(1, n):
        inside = np.flatnonzero((k < whole) & (index + k < len(word)))
        gram[inside] = mix(gram[inside] * _ODD + word[inside + k])
    gram = mix(gram ^ (whole.astype(U64) * _ODD))
    valid = index - first[doc] <= (per - np.minimum(per, n))[doc]
    out = []
    for d in np.flatnonzero(per):
        s = slice(first[d], first[d] + per[d])
        own = np.sort(gram[s][valid[s]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        begins[d + 1] = len(own)
    return np.concatenate(out), np.cumsum(begins)


def sketches(sets: np.ndarray, begins: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketches: `size` coordinates of each set.

    In round i < size every element falls into one coordinate by its i-th hash; in the rounds after, round
    size+j puts all elements into coordinate j. A coordinate keeps the smallest (round, hash), so each is
    filled for sure, large sets fill all in the first round or two, and a set stops once it is full.
    """
    n = len(begins) - 1
    owner = np.repeat(np.arange(n), np.diff(begins))
    empty = U64(0xFFFFFFFFFFFFFFFF)
    flat = np.full(n * size, empty, U64)
    elements, where = sets, owner
    for i in range(2 * size):
        if not len(elements):
            break
        h = mix(elements + U64((i + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        slot = ((h >> U64(40)) * U64(size) >> U64(24)).astype(np.int64) if i < size else i - size
        np.minimum.at(flat, where * size + slot, (U64(i) << U64(55)) | (mix(h) >> U64(9)))
        open_ = (flat.reshape(n, size) == empty).any(axis=1)
        left = open_[where]
        elements, where = elements[left], where[left]
    return flat.reshape(n, size)


def packed_bits(sketch: np.ndarray) -> list[np.ndarray]:
    """The two lowest bits of each coordinate, 32 coordinates a long."""
    low = sketch & U64(3)
    shift = np.arange(32, dtype=U64) * U64(2)
    return [np.bitwise_or.reduce(low[:, i : i + 32] << shift[: low[:, i : i + 32].shape[1]], axis=1).view(np.int64) for i in range(0, low.shape[1], 32)]


def likely(percent: int, x: str, y: str) -> str:
    """SQL condition that two nodes with size and BITS may be linked: it holds for every link but with odds under one in a billion.

    Coordinates of linked sets differ with odds of 1 - percent/100 at most, three in four of them in their two
    bits; six and a half standard deviations more are let pass.
    """
    n, odds = BANDS * ROWS, 0.75 * (1 - percent / 100)
    most = math.ceil(n * odds + 6.5 * math.sqrt(n * odds * (1 - odds)))
    unlike = " + ".join(f"bit_count((({x}.{s} ^ {y}.{s}) | shiftright({x}.{s} ^ {y}.{s}, 1)) & {0x5555555555555555}L)" for s in BITS)
    return f"100 * least({x}.size, {y}.size) >= {percent} * greatest({x}.size, {y}.size) and {unlike} <= {most}"


def sketched(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """node, size of the shingle set, two hashes of the whole set, one key per band, and BITS."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            sets, begins = shingles(batch.column("_text"))
            size = np.diff(begins)
            sums = [np.concatenate(([U64(0)], np.cumsum(mix(sets + U64(k)))))[begins] for k in (1, 2)]
            whole = [(s[1:] - s[:-1]).view(np.int64) for s in sums]
            flat = sketches(sets, begins)
            sketch = flat.reshape(len(size), BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=U64), (len(size), BANDS))
            for r in range(ROWS):
                key = mix(key * _ODD + sketch[:, :, r])
            offsets = np.arange(len(size) + 1, dtype=np.int32) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(key).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(whole[0]), pa.array(whole[1]), bands, *map(pa.array, packed_bits(flat))], names=["node", "size", "h1", "h2", "bands", *BITS])

    rows = df.select(F.col(row_id).cast("long").alias("node"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "node long, size long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{s} long" for s in BITS))


def _sets(df: DataFrame, text: str, row_id: str, wanted: DataFrame) -> DataFrame:
    """node and its shingle set, of the wanted nodes. Rows that share an id are one node: their sets are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            sets, begins = shingles(batch.column("_text"))
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "set"])

    rows = df.select(F.col(row_id).cast("long").alias("node"), F.col(text).alias("_text")).join(small(saved(wanted)), "node", "left_semi")
    return rows.mapInArrow(run, "node long, set array<long>")


def near_duplicates(df: DataFrame, text: str, row_id: str, percent: int = 75) -> DataFrame:
    """row_id, n_shingles, component_id (the smallest id reachable) and kept (it is the smallest) of every row.

    Documents are linked if their sets of 5-word shingles have a Jaccard similarity of `percent`/100 or more.
    Documents with equal sets are one node until the end, so groups of copies cost no pairs. Null texts and
    texts without words have empty sets and are linked with nothing; shorter texts are one shingle. Rows
    with the same id are one node; a row with a null id is its own (component_id null, kept). An empty table
    gives no rows; columns besides the two are not looked at. Shingles are compared by 64-bit hashes.
    """
    rows = saved(sketched(df, text, row_id))
    filled = rows.where("size > 0 and node is not null")
    copies = saved(filled.groupBy("h1", "h2", "size").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))
    led = rows.join(small(copies), ["h1", "h2", "size"], "left").withColumn("leader", F.coalesce("leader", "node"))
    leaders = led.where("size > 0 and node = leader")
    nodes = saved(leaders.select("node", "size", *BITS).dropDuplicates(["node"]))
    buckets = leaders.select(F.explode("bands").alias("key"), "node")
    found = linked(buckets, nodes, lambda wanted: _sets(df, text, row_id, wanted.select("node")), percent, likely(percent, "x", "y"), ["size", *BITS], rounds=1)
    out = with_components(led.select(F.col("node").alias("id"), "size", F.col("leader").alias("node")), found)
    return out.select(F.col("id").alias(row_id), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "doc_id")
