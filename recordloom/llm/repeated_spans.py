"""Removal of every byte that lies in a long string which also starts elsewhere in the corpus.

The sorted-suffix form of this (front-coded runs of all suffixes, merged by loser trees) would exchange
every byte position of the corpus; see the README for why windows at content-chosen anchors stand in for it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import freed, importable, saved, small
from ._words import Rolling, joined, mix, pieces
from ._words import U as U64

WIDTH = 400
GRAM = 32


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


class Anchored:
    """The windows of a batch of texts, by anchor: the place of the smallest gram in a window.

    Which place that is depends on the window's bytes alone, so equal windows anywhere have it at the same
    offset. Windows that follow one another mostly share an anchor: text `doc`, gram at `gram`, windows
    starting at `low` to `high` (all in bytes of the joined buffer).
    """

    def __init__(self, column: pa.Array, width: int) -> None:
        self.width = width
        data, at = joined(column)
        self.data, self.at = data, at
        self.roll = Rolling(data)
        size = np.diff(at) - 1
        self.doc = self.gram = self.low = self.high = np.zeros(0, np.int64)
        many = np.maximum(0, size - width + 1)
        if not many.any():
            return
        n = len(data) - GRAM + 1
        place = np.arange(n)
        keyed = (self.roll.of(place, place + GRAM) & U64(0xFFFFFFFF00000000)) | place.astype(U64)
        where = (_sliding_min(keyed, width - GRAM + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), many)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + at[:-1][owner]
        gram = where[start]
        first = np.flatnonzero(np.diff(gram, prepend=-1) != 0)
        self.doc, self.gram, self.low = owner[first], gram[first], start[first]
        self.high = start[np.append(first[1:], len(start)) - 1]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of each anchor's right and left half-window (where some window has it whole), and of all its windows together."""
        half = self.width // 2
        right, left = self.high >= self.gram - half, self.low < self.gram - half
        r, l, g = np.zeros(len(self.gram), U64), np.zeros(len(self.gram), U64), self.gram
        r[right] = self.roll.of(g[right], g[right] + half)
        l[left] = mix(self.roll.of(g[left] - half, g[left] + GRAM))
        around = self.roll.of(self.low, self.high + self.width)
        return right, r, left, l, mix(around ^ mix((g - self.low).astype(U64)) ^ (self.high - self.low).astype(U64))


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            a = Anchored(batch.column("_text"), width)
            right, r, left, l, whole = a.keys()
            base = a.at[a.doc]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(pa.array(a.doc)), pa.array((a.low - base).astype(np.int32)), pa.array((a.high - base).astype(np.int32)),
                pa.array(r.view(np.int64), mask=~right), pa.array(l.view(np.int64), mask=~left), pa.array(whole.view(np.int64)),
            ], names=["doc", "low", "high", "r", "l", "whole"])

    return docs.mapInArrow(run, "doc long, low int, high int, r long, l long, whole long")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """whole, and the hashes of all windows, of the anchors whose first window starts at one of `lows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            a = Anchored(batch.column("_text"), width)
            lows = batch.column("lows")
            wanted = lows.flatten().to_numpy() + np.repeat(a.at[:-1], pa.compute.list_value_length(lows).to_numpy())
            some = np.isin(a.low, wanted)
            low, many, whole = a.low[some], (a.high - a.low)[some] + 1, a.keys()[4][some]
            ends = np.cumsum(many)
            start = np.arange(many.sum()) - np.repeat(ends - many, many) + np.repeat(low, many)
            hashes = pa.array(a.roll.of(start, start + width).view(np.int64)) if len(start) else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), lists], names=["whole", "windows"])

    return docs.mapInArrow(run, "whole long, windows array<long>")


def repeated_spans(df: DataFrame, text: str, row_id: str, width: int = WIDTH) -> DataFrame:
    """doc (hash of id and text), and spans (from, to): bytes inside strings of `width` bytes that start elsewhere too.

    1. Each text's windows are grouped by anchor. A window holds the right or the left half-window of its
       anchor, so an anchor none of whose halves occurs twice has no repeated window: most end here.
    2. Anchors whose windows all occur twice, as inside long copies, are found by one hash of them all.
    3. The rest, at the ends of copies, compare the hashes of their windows, one text for all equal anchors.
    Hot halves and windows are counted by partial aggregates; nothing is paired.
    """
    importable(df.sparkSession)
    docs = df.select(F.xxhash64(row_id, text).alias("doc"), F.coalesce(text, F.lit("")).alias("_text")).where(F.octet_length("_text") >= width)
    anchors = saved(_anchors(docs, width))
    halves = anchors.select(F.explode(F.array_compact(F.array("r", "l"))).alias("half"), "doc", "low", "high", "whole")
    twice = saved(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    near = saved(halves.join(small(twice), "half").select("doc", "low", "high", "whole", "half"))
    freed(anchors, twice)
    groups = near.groupBy("whole", "half").agg(F.count("*").alias("n"), F.min(F.struct("doc", "low")).alias("one"))
    groups = saved(groups)
    lone = saved(groups.where("n = 1").select("half").distinct())
    compared = saved(groups.join(small(lone), "half", "left_semi").groupBy("whole").agg(F.first("one").alias("one"), F.min("n").alias("n")))
    wanted = saved(compared.groupBy(F.col("one.doc").alias("doc")).agg(F.collect_list("one.low").alias("lows")))
    texts = docs.join(wanted, "doc")
    windows = saved(_windows(texts, width).dropDuplicates(["whole"]))
    freed(lone, wanted)
    single = windows.select("whole", F.posexplode("windows").alias("nth", "hash"))
    again = saved(single.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    lone_wholes = saved(compared.where("n = 1").select("whole", F.col("one.doc").alias("doc"), F.col("one.low").alias("low")))
    ends = single.join(again, "hash").join(lone_wholes, "whole").select("doc", (F.col("low") + F.col("nth")).alias("from"))
    ends = saved(ends.distinct().select("doc", "from", (F.col("from") + width).alias("to")))
    freed(windows, again, compared, lone_wholes)
    copied = saved(groups.where("n > 1").select("whole").distinct())
    freed(groups)
    inner = near.join(small(copied), "whole", "left_semi").select("doc", F.col("low").alias("from"), (F.col("high") + width).alias("to"))
    found = saved(inner.union(ends))
    freed(near, copied, ends)
    return found


def without_repeats(df: DataFrame, text: str, row_id: str, keep: list[str], width: int = WIDTH) -> DataFrame:
    """Columns `keep`, n_bytes, n_removed, n_spans and `left` (the remaining bytes) of every row.

    A null text is empty; texts shorter than `width` bytes lose nothing; texts are judged on the input, as
    bytes, each by itself, so a repeated row counts as another text and both lose all. An empty table gives
    no rows; columns of `keep` named like the new ones, doc or _text are not allowed. Strings are compared
    by 64-bit hashes.
    """
    spans = repeated_spans(df, text, row_id, width)
    per = saved(spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("_spans")))
    freed(spans)
    rows = df.select(*keep, F.xxhash64(row_id, text).alias("doc"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.join(per.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc"), "left").drop("doc", "_doc")
    schema = df.select(*keep).schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(c, "long", False)
    schema = schema.add("left", "binary", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            out: tuple[list, ...] = ([], [], [], [])
            for raw, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                raw = raw.as_buffer().to_pybytes()
                kept, last, n = [], 0, 0
                if spans.is_valid:
                    end = -1
                    for a, b in sorted((s["from"], s["to"]) for s in spans.as_py()):
                        if a > end:
                            n += 1
                            kept.append(raw[max(last, 0) : a])
                        end = last = max(end, b)
                left = b"".join([*kept, raw[last:]])
                for column, x in zip(out, (len(raw), len(raw) - len(left), n, left), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)




def op9_repeated_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = without_repeats(docs, "text", "doc_id", ["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
