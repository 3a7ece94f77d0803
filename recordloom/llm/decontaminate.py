"""Benchmark decontamination with a generalised suffix automaton of the test items."""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import importable, saved
from ._words import pieces

#: Bytes of items in one automaton; more items are taken in further passes, one automaton each.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the ASCII-lower-cased UTF-8 bytes: runs of digits, a-z and everything beyond ASCII."""
    return _WORD.findall((text or "").encode().translate(_LOWER))


class SuffixAutomaton:
    """All substrings (of words) of all items; a state stands for substrings with the same end places.

    A window is `width` consecutive words of an item, or a whole item of fewer words.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(i, [self.ids.setdefault(w, len(self.ids)) for w in words_of(t)]) for i, t in items]
        texts = [(i, t) for i, t in texts if t]
        for _, text in texts:
            at = 0
            for w in text:
                at = self._extend(at, w)
        self.shortest = min([width, *(len(t) for _, t in texts)])
        #: By state: items whose windows end there (those of `width` words), and short whole items.
        self.full: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for item, text in texts:
            for state, length, _ in self.follow(text):
                if length >= width:
                    self.full.setdefault(self._window(state), set()).add(item)
            if len(text) < width:
                self.short.setdefault(state, []).append((len(text), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.near_short = [False] * len(self.link)
        for s in order:
            self.near_short[s] = s in self.short or self.near_short[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the substrings of at most length[p]+1 words."""
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.width:
            state = self.link[state]
        return state

    def follow(self, text: list[int]) -> Iterator[tuple[int, int, int]]:
        """After each word: state and length of the longest suffix read so far that some item holds, and the place."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for i, w in enumerate(text):
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            yield state, size, i

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs of words inside any window's occurrence, and the items with occurring windows."""
        ids = list(map(self.ids.get, words))
        ids.append(None)
        found: list[tuple[int, int]] = []
        items: set = set()
        begin = 0
        while begin < len(words):
            try:
                end = ids.index(None, begin)
            except ValueError:
                break
            if end - begin >= self.shortest:
                self._scan(ids[begin:end], begin, found, items)
            begin = end + 1
        return found, items

    def _scan(self, run: list[int], begin: int, found: list, items: set) -> None:
        for state, size, i in self.follow(run):
            most = 0
            if size >= self.width:
                most = self.width
                items |= self.full[self._window(state)]
            if self.near_short[state]:
                s = state
                while s > 0 and self.near_short[s]:
                    for n, item in self.short.get(s, ()):
                        if n <= size:
                            most = max(most, n)
                            items.add(item)
                    s = self.link[s]
            if most:
                at = begin + i + 1
                start = at - most
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, at))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last word of each run."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    kept, last = [], 0
    for a, b in runs:
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode()


def _matched(df: DataFrame, automaton: Broadcast, first: bool) -> DataFrame:
    schema = T.StructType(df.schema.fields[:])
    if first:
        schema = schema.add("n_words", "long").add("hit_runs", T.ArrayType(T.IntegerType())).add("hit_items", T.ArrayType(T.StringType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        for batch in pieces(batches, "_text"):
            counts, runs, items = [], [], []
            had = [[]] * len(batch) if first else batch.column("hit_runs").to_pylist()
            old = [[]] * len(batch) if first else batch.column("hit_items").to_pylist()
            for text, a, b in zip(batch.column("_text").to_pylist(), had, old, strict=True):
                words = words_of(text)
                found, named = machine.hits(words)
                counts.append(len(words))
                if a:
                    found = _merged(found + list(zip(a[::2], a[1::2], strict=True)))
                runs.append([x for r in found for x in r])
                items.append(sorted({*b, *(x for x in named if x is not None)}))
            new = {"n_words": pa.array(counts, pa.int64()), "hit_runs": pa.array(runs, pa.list_(pa.int32())), "hit_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return df.mapInArrow(run, schema)


def matches(df: DataFrame, text: str, keep: list[str], benchmark: DataFrame, item_id: str, item_text: str, width: int = 10) -> DataFrame:
    """Columns `keep`, _text, n_words, hit_runs (first and end word of each run, in turn) and hit_items of each row.

    Items are taken in blocks of about BLOCK_BYTES; each block's automaton, so of bounded size, is broadcast
    and every whole text streams through it. Null texts and texts without words have no hits; items without
    words have no windows; an item with a null id counts as a hit but is not named; items with the same id
    are one. Repeated rows are matched one by one; an empty table gives no rows. Columns of `keep` named
    _text, n_words, hit_runs or hit_items are not allowed.
    """
    spark: SparkSession = df.sparkSession
    importable(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    out = df.select(*keep, F.col(text).alias("_text"))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        machine = spark.sparkContext.broadcast(SuffixAutomaton([(r.i, r.t) for r in own.collect()], width))
        out = _matched(out if b == 0 else saved(out), machine, b == 0)
    return out


def n_hit(runs: str = "hit_runs"):
    return F.expr(f"aggregate({runs}, 0L, (s, x) -> x - s)")


def cleaned(df: DataFrame, text: str, keep: list[str], benchmark: DataFrame, item_id: str, item_text: str, width: int = 10, most: float = 0.5) -> DataFrame:
    """Rows with the contaminated spans taken out of their texts; a text with more than the share `most` of its words hit goes."""
    found = matches(df, text, keep, benchmark, item_id, item_text, width)
    within = found.where((F.size("hit_runs") == 0) | (n_hit() <= most * F.col("n_words"))).select(*keep, "_text", "hit_runs")
    schema = within.select(*keep, "_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            for i, r in enumerate(batch.column("hit_runs").to_pylist()):
                if r:
                    texts[i] = _without(texts[i], list(zip(r[::2], r[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "_text"])

    return within.mapInArrow(run, schema).withColumnRenamed("_text", text)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = matches(docs, "text", ["doc_id"], items, "item_id", "text")
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )
