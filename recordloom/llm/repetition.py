"""Repetition coverage: characters inside duplicated n-grams and lines of a text, by rolling hashes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import importable
from ._words import NOT_SPACE, Rolling, doc_of, joined, mix, pieces, spans
from ._words import U as U64

#: The share of a text's word characters that duplicated n-grams of each length may cover.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def covered(first: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words that starts at a True of `first`."""
    step = np.zeros(words + n + 1, np.int32)
    step[np.flatnonzero(first)] += 1
    step[np.flatnonzero(first) + n] -= 1
    return np.cumsum(step)[:words] > 0


def measures(column: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """One value per text of the batch."""
    data, at = joined(column)
    texts = len(at) - 1
    start, end = spans(NOT_SPACE[data])
    doc = doc_of(start, at)
    roll = Rolling(data)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    width = letters[end] - letters[start]
    total = np.bincount(doc, width, texts)
    out = {"n_words": np.bincount(doc, minlength=texts), "word_chars": total, "n_symbols": np.bincount(doc_of(np.flatnonzero(_SYMBOLS[data]), at), minlength=texts)}

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1)).astype(np.int64)
    filled = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[filled], line_end[filled]
    owner = doc_of(line_start, at)
    salt = mix(np.arange(1, texts + 1, dtype=U64))
    twice, later = repeated(roll.of(line_start, line_end) ^ salt[owner])
    inside = np.concatenate(([0], np.cumsum(width)))
    line_chars = inside[np.searchsorted(start, line_end)] - inside[np.searchsorted(start, line_start)]
    out["n_dup_lines"] = np.bincount(owner, later, texts)
    out["dup_line_chars"] = np.bincount(owner, later * line_chars, texts)

    word = roll.of(start, end) if len(start) else np.zeros(0, U64)
    words = len(word)
    gram, k = word.copy(), 1
    for n in (3, *lengths):
        while k < n and words > k:
            gram[: words - k] = mix(gram[: words - k] * U64(0x9E3779B97F4A7C15) + word[k:])
            k += 1
        hit = np.zeros(words, bool)
        if words >= n:
            whole = np.flatnonzero(doc[: words - n + 1] == doc[n - 1 :])
            hit[whole] = repeated(gram[whole] ^ salt[doc[whole]])[0]
        inside_hit = covered(hit, n, words)
        if n == 3:
            out["n_repeat_words"] = np.bincount(doc, inside_hit, texts)
        if n in lengths:
            out[f"dup_{n}gram_chars"] = np.bincount(doc, inside_hit * width, texts)
    return {k: v.astype(np.int64) for k, v in out.items()}


def repetition(df: DataFrame, text: str, keep: list[str], lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> DataFrame:
    """Columns `keep` of each row and counts of repetition inside its whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars and dup_<n>gram_chars for
    each length (ascending, above 2). Null texts and texts without words give zeros; rows are measured by
    themselves, so repeated rows, ties and extra columns do not matter; an empty table gives no rows.
    N-grams are compared by 64-bit hashes within one text.
    """
    importable(df.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in lengths)]
    schema = df.select(*keep).schema
    for x in names:
        schema = schema.add(x, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            got = measures(batch.column("_text"), lengths)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(got[x]) for x in names)], names=[*keep, *names])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed, and kept: not base_failed and every coverage within its limit."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, most in NGRAM_LIMITS.items():
        fine = fine & (F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & fine)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(repetition(docs, "text", ["doc_id"])).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_LIMITS),
    )
