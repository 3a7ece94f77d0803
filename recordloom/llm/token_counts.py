"""Token counts of a byte-level BPE by rank-synchronous merging of ragged numpy arrays."""

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pretokens import Memo
from ._store import importable
from ._words import pieces

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """The merge list of a tokenizer file as sorted arrays: pair of symbols -> rank and merged symbol."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        rows = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in rows], np.int64).reshape(-1, 3)
        self.width = max(vocab.values()) + 1
        keys = ids[:, 0] * self.width + ids[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, ids[order, 2]
        self.symbol = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.letters = {c: b for b, c in enumerate(byte_letters())}
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def pretokens(self, chunk: str) -> list[bytes]:
        """UTF-8 of the chunk's pre-tokens. Beyond Latin letters the library's own splitter decides what is a letter."""
        if chunk.isascii() or max(chunk) < "ɐ":
            return [x.encode() for x in self.pattern.findall(chunk)]
        return [bytes(map(self.letters.__getitem__, x)) for x, _ in self.pre.pre_tokenize_str(chunk)]

    def counts(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk; a special string counts as one token."""
        words: dict[bytes, int] = {}
        owner, word = [], []
        extra = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if self.special and self.special.search(chunk):
                parts = self.special.split(chunk)
                extra[i] = len(parts) // 2
                parts = parts[::2]
            for x in (w for part in parts for w in self.pretokens(part)):
                owner.append(i)
                word.append(words.setdefault(x, len(words)))
        sizes = self.merged_sizes(list(words))
        total = np.bincount(np.array(owner, np.int64), sizes[np.array(word, np.int64)], len(chunks)) if owner else 0
        return (total + extra).astype(np.int64).tolist()

    def merged_sizes(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word once no pair can be merged.

        All words lie in one flat array. Each round looks up the rank of every adjacent pair, takes each
        word's lowest rank and merges all its places at once; a run such as aaaa gives every second place.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        result = sizes.copy()
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        live = np.flatnonzero(sizes > 1)
        keep = np.repeat(sizes > 1, sizes)
        symbols, sizes = symbols[keep], sizes[live]
        while len(live):
            starts = np.cumsum(sizes) - sizes
            pair = np.append(symbols[:-1] * self.width + symbols[1:], -1)
            pair[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pair, self.rank[at], _NONE)
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            places = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(places, prepend=-2) != 1)  # where runs of adjacent places begin
            nth = np.arange(len(places)) - np.repeat(run, np.diff(run, append=len(places)))
            places = places[nth % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            sizes = np.add.reduceat(keep, starts, dtype=np.int64)
            result[live] = sizes
            more = (lowest != _NONE) & (sizes > 1)
            symbols = symbols[keep & np.repeat(more, np.diff(np.append(starts, len(keep))))]
            live, sizes = live[more], sizes[more]
        return result


@functools.cache
def _memo(path: str) -> Memo:
    return Memo(Merges(path).counts)


def token_counts(df: DataFrame, text: str, keep: list[str], path: str) -> DataFrame:
    """Columns `keep` of each row, n_bytes and n_tokens of its whole text (null: empty, so 0 and 0).

    path names a byte-level BPE tokenizer file that executors can read. Repeated rows, ties and extra
    columns do not matter: every row is counted by itself. A worker's memory is bounded by its batch of
    texts and by a memo of 400,000 chunks. An empty table gives no rows.
    """
    importable(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("_text"))
    schema = df.select(*keep).schema.add("n_bytes", "long", False).add("n_tokens", "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in pieces(batches, "_text"):
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            counts = [sum(r) for r in memo.rows(texts)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes, pa.array(counts, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k, and whether they exceed a 512-token context."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = token_counts(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
