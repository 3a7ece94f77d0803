"""Pattern packing: few-document length patterns, repeat counts by non-negative least squares, best-fit residuals."""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pretokens import encoder
from ._ranks import ranked
from ._store import importable, saved
from ._words import pieces

Pattern = tuple[tuple[int, ...], int]
#: Shares of the fitted sequences, those with the fewest free tokens first, that a plan is tried with.
QUANTILES = (0.5, 0.9, 1)
#: Parts of the fitted repeat counts that are rounded down; what they leave is packed best-fit.
PARTS = (1, 0.75, 0.5)


def patterns_of(lengths: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of one to four present lengths that fill `size` as far as present lengths allow."""
    present = np.sort(lengths)

    def largest(most: int) -> int:
        i = int(np.searchsorted(present, most, "right"))
        return int(present[i - 1]) if i else 0

    found = set()
    for a in present.tolist():
        rest = size - a
        found.add(tuple(x for x in (a, largest(rest)) if x))
        for part in (2, 3, 4, 8):
            b = largest(rest // part)
            if b:
                c = largest(rest - b)
                found.add(tuple(sorted((x for x in (a, b, c) if x), reverse=True)))
                if c and (d := largest((rest - b) // 2)):
                    found.add(tuple(sorted((x for x in (a, b, d, largest(rest - b - d)) if x), reverse=True)))
    return sorted({p for p in found if p and sum(p) <= size}, reverse=True)


def fitted(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeat counts whose lengths add up to the histogram."""
    row = np.array([x for p in patterns for x in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    n, m = len(patterns), len(counts)
    forward = lambda x: np.bincount(row, x[col], m)
    back = lambda y: np.bincount(col, y[row], n)
    v = np.ones(n)
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - counts) / (1.05 * norm))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def best_fit(left: np.ndarray, size: int) -> list[Pattern]:
    """Packs what is left: the longest first, then always the longest that still fits; equal sequences at once."""
    out: list[Pattern] = []
    while left.any():
        room, used = size, []
        while True:
            fits = np.flatnonzero(left[: room + 1])
            if not len(fits):
                break
            x = int(fits[-1])
            n = min(int(left[x]), room // x) if used else 1
            used += [x] * n
            left[x] -= n
            room -= x * n
        times = 1
        share, need = np.unique(used, return_counts=True)
        times += int((left[share] // need).min())
        left[share] -= need * (times - 1)
        out.append((tuple(used), times))
    return out


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """Patterns and how often each is used, such that every piece has its place.

    Fitted repeat counts are rounded down as far as pieces are left, and the rest is packed best-fit. How
    many free tokens a pattern may have is taken from the fit: a quantile of the free tokens of its
    sequences. Of these plans and PARTS of the counts, the one that needs the fewest sequences is taken.
    """
    if not counts:
        return []
    full = np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        full[k] = v
    patterns = patterns_of(np.flatnonzero(full), size)
    times = fitted(patterns, full.astype(float))
    free = size - np.array([sum(p) for p in patterns])
    order = np.argsort(free, kind="stable")
    share = np.cumsum(times[order]) / (times.sum() or 1.0)
    limits = {int(free[order[min(np.searchsorted(share, q), len(order) - 1)]]) for q in QUANTILES}
    plans = [_rounded(patterns, np.where(free <= limit, times, 0) * part, full, size) for limit in sorted(limits) for part in PARTS]
    return min(plans, key=lambda c: sum(n for _, n in c))


def _rounded(patterns: list[tuple[int, ...]], times: np.ndarray, full: np.ndarray, size: int) -> list[Pattern]:
    """Whole repeat counts of the patterns, their sum kept, and the pieces that are left packed best-fit.

    Counts are rounded down, and what their sum lacks goes, one each, to the patterns with the largest
    fractions, for as long as there are pieces for them.
    """
    left, floors = full.copy(), np.floor(times + 1e-6)
    needs = [np.unique(p, return_counts=True) for p in patterns]
    used = np.zeros(len(patterns), np.int64)
    lacking = int(times.sum()) - int(floors.sum())
    for order, wanted in ((np.argsort(-times, kind="stable"), floors), (np.argsort(floors - times, kind="stable"), times > floors)):
        rest = int(floors.sum()) if wanted is floors else lacking
        for j in order:
            if rest <= 0:
                break
            n = int(min(wanted[j], (left[needs[j][0]] // needs[j][1]).min()))
            if n > 0:
                left[needs[j][0]] -= needs[j][1] * n
                used[j] += n
                rest -= n
    return [(patterns[j], int(used[j])) for j in np.flatnonzero(used)] + best_fit(left, size)


def placed(df: DataFrame, length: str, order: list[str], size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `size` (and at least 1).

    Only the histogram, at most `size` rows, goes to the driver. A piece's rank among those of its length
    finds its pattern, and so its sequence, in the plan, whose rows number at most a few for each length
    and pattern whatever the input's size.
    """
    importable(df.sparkSession)
    rows = saved(ranked(df, order, [length], "_nth"))
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}
    entries, used, base = [], dict.fromkeys(counts, 0), 0
    for pattern, n in plan(counts, size):
        at = 0
        slots: dict[int, list[int]] = {}
        for x in pattern:
            slots.setdefault(x, []).append(at)
            at += x
        for x, offsets in slots.items():
            entries.append(((x << 40) + used[x], base, offsets))
            used[x] += n * len(offsets)
        base += n
    entries.sort()
    keys = np.array([e[0] for e in entries], np.int64)
    bases = np.array([e[1] for e in entries], np.int64)
    many = np.array([len(e[2]) for e in entries], np.int64)
    first = np.cumsum(many) - many
    offsets = np.array([o for e in entries for o in e[2]], np.int64)
    table = df.sparkSession.sparkContext.broadcast((keys, bases, many, first, offsets))
    keep = df.columns
    schema = df.select(*keep).schema.add("sequence_id", "long", False).add("offset", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, many, first, offsets = table.value
        for batch in batches:
            if len(batch):
                key = (batch.column(length).to_numpy().astype(np.int64) << 40) + batch.column("_nth").to_numpy()
                e = np.searchsorted(keys, key, "right") - 1
                nth = key - keys[e]
                new = [pa.array(bases[e] + nth // many[e]), pa.array(offsets[first[e] + nth % many[e]])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)


def cut(df: DataFrame, text: str, row_id: str, path: str, size: int) -> DataFrame:
    """row_id, piece, start, length and ids_crc32 of each row's pieces: its tokens and then id 0, at most `size` a piece."""
    importable(df.sparkSession)
    rows = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    schema = rows.select("_id").schema.add("piece", "integer", False).add("start", "long", False).add("length", "long", False).add("ids_crc32", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in pieces(batches, "_text"):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in enumerate(batch.column("_text").to_pylist()):
                ids = memoryview(encode(text or "").astype("<u4").tobytes() + b"\0\0\0\0")
                n = len(ids) // 4
                start, nth = 0, 0
                while start < n:
                    end = start + ((n - start) % size or size)
                    for column, x in zip(out, (i, nth, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                        column.append(x)
                    start, nth = end, nth + 1
            key = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([key, pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(df: DataFrame, text: str, row_id: str, path: str, size: int = 2048) -> DataFrame:
    """Every piece of every whole text in its sequence.

    Null and empty texts have one piece, id 0. A text of more than `size` ids is cut from its end into pieces
    of `size`, so that the first may be shorter. Repeated rows and null ids are packed like others; an empty
    table gives no rows; other columns of df are not looked at. An id column named like a new one is refused.
    """
    if row_id in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset"):
        raise ValueError(f"the id column is named like a new column: {row_id}")
    return placed(saved(cut(df, text, row_id, path, size)), "length", ["_id", "piece", "ids_crc32"], size).withColumnRenamed("_id", row_id)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, "text", "doc_id", public_tokenizers.path("byte_bpe_50k.json"))
