"""Quality by hierarchical empirical Bayes: a document's own evidence with the posteriors of its host and path."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import importable, saved
from ._words import LOWER, NOT_SPACE, Rolling, doc_of, joined, pieces, spans
from ._words import U as U64

#: Word buckets of the classifier, and the shape features that follow them.
BUCKETS = 1 << 17
SHAPES = 15
#: The classifier is fitted on at most so many labelled rows; everything else looks at every row.
FIT_ROWS = 6000
#: Documents as many as whose evidence a level's prior counts.
PRIOR = 50.0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words and word beginnings, one text after the other; where each begins; shape features."""
    data, at = joined(column)
    texts = len(at) - 1
    lower = LOWER[data]
    letter = ((lower >= 0x61) & (lower <= 0x7A)) | (lower >= 0x80)
    mark = NOT_SPACE[data] & ~letter & ~((data >= 0x30) & (data <= 0x39))
    roll = Rolling(lower)
    share = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[at]) / size
    size = np.maximum(1, np.diff(at) - 1)

    begin, end = spans(letter)
    owner = doc_of(begin, at) * BUCKETS
    keys = []
    for k, most in enumerate((64, 4, 5)):
        stop = np.minimum(end, begin + most)
        some = slice(None) if k == 0 else end - begin >= most
        keys.append(owner[some] + ((roll.of(begin[some], stop[some]) + U64(k)) % U64(BUCKETS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    begins = np.searchsorted(key // BUCKETS, np.arange(texts + 1))

    start, stop = spans(NOT_SPACE[data])
    doc = doc_of(start, at)
    words = np.bincount(doc, minlength=texts)
    n = np.maximum(words, 1)
    whole = roll.of(start, stop)
    again = np.bincount(doc[1:][(whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])], minlength=texts) / n if len(doc) else np.zeros(texts)
    different = np.bincount(np.unique(np.stack([doc.astype(U64), whole]), axis=1)[0].astype(np.int64), minlength=texts) / n if len(doc) else np.zeros(texts)
    marks, upper, bars = share(mark), share(data != lower), share(data == 0x7C)
    shapes = np.stack([
        np.ones(texts), marks * 4, marks > 0.08, upper * 4, upper > 0.25, bars * 8, bars > 0.01, again * 4, again > 0.1,
        different, different < 0.3, words < 50, words < 20, np.log1p(words) / 10, share((data >= 0x30) & (data <= 0x39)) * 4,
    ], axis=1)
    return key % BUCKETS, begins, shapes.astype(float)


def evidence(table: np.ndarray, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Shape features, and the strongest and the summed word evidence for and against, of each text."""
    buckets, begins, shapes = parts
    w = np.append(table[buckets], 0.0)
    some = np.diff(begins) > 0
    at = np.minimum(begins[:-1], len(buckets))
    high = np.where(some, np.maximum(0, np.maximum.reduceat(w, at)), 0)
    low = np.where(some, np.minimum(0, np.minimum.reduceat(w, at)), 0)
    sums = [np.diff(np.concatenate(([0.0], np.cumsum(x)))[begins]) for x in (np.maximum(w[:-1] - 1, 0), np.minimum(w[:-1] + 1, 0))]
    return np.column_stack([shapes, high, low, np.log1p(sums[0]), -np.log1p(-sums[1])])


def fit(cut: list[tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word evidence, and the coefficients of a ridge logistic regression on `evidence`, by Newton steps.

    A bucket's evidence is its smoothed log odds between the classes, drawn towards zero by two standard
    errors, so that rare words say nothing.
    """
    size = np.array([(target > 0).sum(), (target <= 0).sum()], float)
    if not size.all():
        flat = np.zeros(SHAPES + 4)
        flat[0] = 0.0 if not size.any() else 4.0 if size[0] else -4.0
        return np.zeros(BUCKETS), flat
    seen = np.zeros((2, BUCKETS))
    at = 0
    for buckets, begins, _ in cut:
        own = np.repeat(target[at : at + len(begins) - 1] > 0, np.diff(begins))
        at += len(begins) - 1
        seen += [np.bincount(buckets[own], minlength=BUCKETS), np.bincount(buckets[~own], minlength=BUCKETS)]
    odds = np.log((seen[0] + 0.5) / (size[0] + 1)) - np.log((seen[1] + 0.5) / (size[1] + 1))
    error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    table = np.sign(odds) * np.maximum(0, np.abs(odds) - 2 * error)
    x = np.concatenate([evidence(table, c) for c in cut])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 0.3 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), gradient)
    return table, w


def learned(df: DataFrame, text: str, row_id: str, labels: DataFrame, label_id: str, heads: list[str], most: int = FIT_ROWS) -> list:
    """One fitted classifier per 0/1 column of labels, from at most `most` labelled rows, picked by a hash of their id.

    The rows' features are computed by tasks; what reaches the driver is bounded by `most` rows of at most
    BUCKETS numbers. A null label leaves its row out of that classifier.
    """
    importable(df.sparkSession)
    picked = labels.select(F.col(label_id).alias("_id"), *heads).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            buckets, begins, shapes = features(batch.column("_text"))
            lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(h).cast(pa.float64()) for h in heads), lists, pa.array(shapes.tolist(), pa.list_(pa.float64()))], names=[*heads, "buckets", "shapes"])

    schema = ", ".join(f"{h} double" for h in heads) + ", buckets array<int>, shapes array<double>"
    got = rows.mapInArrow(run, schema).toArrow()
    out = []
    for h in heads:
        own = got.filter(pa.compute.is_valid(got[h])).combine_chunks()
        target = own[h].to_numpy()
        parts = []
        if len(target):
            lists = own["buckets"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            begins = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            shapes = np.array(own["shapes"].to_pylist(), float)
            parts = [(lists.flatten().to_numpy(), begins, shapes)]
        out.append(fit(parts, target))
    return out


def scored(df: DataFrame, text: str, heads: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """df and, for each head, the log odds that the document's own text gives."""
    importable(df.sparkSession)
    models = df.sparkSession.sparkContext.broadcast(list(heads.values()))  # BUCKETS numbers each
    keep = df.columns
    schema = df.select(*keep).schema
    for h in heads:
        schema = schema.add(h, "double", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            cut = features(batch.column(text))
            z = [pa.array(np.clip(evidence(table, cut) @ w, -30, 30)) for table, w in models.value]
            yield pa.RecordBatch.from_arrays([*batch.columns, *z], names=schema.names)

    return df.mapInArrow(run, schema)


def _odds(p):
    return F.log(p / (1 - p))


def with_sites(df: DataFrame, head: str, host: str, path: list[str], prior: float = PRIOR) -> DataFrame:
    """Adds `<head>_host`, `<head>_path` (posterior rates) and `<head>_posterior` (a probability) to scored rows.

    A path is the host and the columns `path`. Rates are the mean of the documents' own probabilities, drawn
    towards the level above as if `prior` documents had that level's rate: the path's towards its host's,
    the host's towards the corpus's. A document's log odds move by its path's log odds over the corpus's.
    Groups, hot ones too, are summed up by partial aggregates; only one row per path is joined back.
    """
    own = 1 / (1 + F.exp(-F.col(head)))
    sums = saved(df.groupBy(host, *path).agg(F.sum(own).alias("_s"), F.count("*").alias("_n")))
    total = sums.agg(F.sum("_s"), F.sum("_n")).first()
    rate = min(max((total[0] or 0.5) / (total[1] or 1), 1e-6), 1 - 1e-6)
    hosts = sums.groupBy(F.col(host).alias("_host")).agg(((F.sum("_s") + prior * rate) / (F.sum("_n") + prior)).alias(f"{head}_host"))
    sites = sums.join(hosts, F.col(host).eqNullSafe(F.col("_host")))
    level = (F.col("_s") + prior * F.col(f"{head}_host")) / (F.col("_n") + prior)
    sites = saved(sites.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([host, *path])), f"{head}_host", level.alias(f"{head}_path")))
    same = [df[c].eqNullSafe(sites[f"_k{i}"]) for i, c in enumerate([host, *path])]
    odds = F.col(head) + _odds(F.col(f"{head}_path")) - float(np.log(rate / (1 - rate)))
    joined_up = df.join(sites, same).drop(*(f"_k{i}" for i in range(len(same))))
    return joined_up.withColumn(f"{head}_posterior", 1 / (1 + F.exp(-odds)))


def verdict():
    return (F.col("quality_posterior") >= 0.5) & (F.col("toxic_posterior") <= 0.5)


def judged(df: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", host: str = "source", path: tuple[str, ...] = ("lang",)) -> DataFrame:
    """df with the evidence, site rates and posteriors of `quality` and `toxic`, and kept: good and not toxic.

    labels has row_id, quality and toxic (0/1 or null). Null and empty texts are judged by their shape alone;
    null hosts and paths are groups of their own; repeated rows count as often as they occur; without labels
    every document is as likely good as bad, and kept. An empty table gives no rows. Columns of df named
    quality, toxic, kept or beginning with those and _host, _path or _posterior are not allowed.
    """
    models = dict(zip(("quality", "toxic"), learned(df, text, row_id, labels, row_id, ["quality", "toxic"]), strict=True))
    rows = saved(scored(df, text, models))
    for head in models:
        rows = with_sites(rows, head, host, list(path))
    return rows.withColumn("kept", verdict())


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = [f"{h}_{x}" for h in ("quality", "toxic") for x in ("host", "path", "posterior")]
    models = dict(zip(("quality", "toxic"), learned(docs, "text", "doc_id", labels, "doc_id", ["quality", "toxic"]), strict=True))
    rows = saved(scored(docs.select("doc_id", "source", "lang", "text"), "text", models).drop("text"))
    for head in models:
        rows = with_sites(rows, head, "source", ["lang"])
    return rows.select("doc_id", "quality", "toxic", *rates, verdict().alias("kept"))
