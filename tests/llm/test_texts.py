"""Operators 4, 6, 7, 8 and 10 against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import warc
from recordloom.llm.decontaminate import SuffixAutomaton, cleaned, words_of
from recordloom.llm.graph import components
from recordloom.llm.packing import plan
from recordloom.llm.queries import QUERIES
from recordloom.llm.site_quality import judged

from .conftest import DOCS, ODD_TEXTS

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def items_of(spark, folder, rows, schema="item_id string, text string"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/benchmark.parquet")


def plain_hits(text, items, width=10):
    words = words_of(text)
    hit, named = set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                named.add(item)
    return len(words), len(hit), named


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc ", max_size=14), max_size=4), st.text("abcd ", max_size=60))
def test_automaton_equals_plain_windows(items, text):
    items = [(str(i), t) for i, t in enumerate(items)]
    runs, named = SuffixAutomaton(items, 3).hits(words_of(text))
    n, hit, want = plain_hits(text, items, 3)
    assert sum(b - a for a, b in runs) == hit and named == want


def test_decontamination_query(spark, corpus):
    long = " ".join(f"q{i}" for i in range(25))
    texts = [*ODD_TEXTS, "see Q3 q4 q5 q6, q7 q8 q9 q10 q11 q12! end", long + " " + long, "only q1 q2 q3", "Tiny Item here", "tiny item"]
    items = [("b", long), ("a", long.upper() + " more"), ("s", "tiny item"), ("n", None), ("e", "!!"), (None, "fox jumps")]
    folder = corpus(texts)
    items_of(spark, folder, items)
    for r in QUERIES["op7_decontamination"](spark, folder).collect():
        n, hit, named = plain_hits(texts[r.doc_id], items)
        named = sorted(named - {None})
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(named), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()


def test_many_blocks_of_items_find_the_same(spark, corpus, monkeypatch):
    rng = random.Random(3)
    items = [(str(i), " ".join(rng.choice("abcdefgh") for _ in range(14))) for i in range(9)]
    folder = corpus([" ".join([t, "x", items[(i * 5) % 9][1]]) for i, (_, t) in enumerate(items)])
    items_of(spark, folder, items)
    one = QUERIES["op7_decontamination"](spark, folder).collect()
    monkeypatch.setattr("recordloom.llm.decontaminate.BLOCK_BYTES", 90)
    assert sorted(one) == sorted(QUERIES["op7_decontamination"](spark, folder).collect())


def test_cleaning_takes_spans_out_and_drops_what_is_mostly_benchmark(spark):
    docs = spark.createDataFrame([(1, "before: A b, c d! after this and that is fine"), (2, "a b c d e"), (3, None)], "id long, t string")
    items = spark.createDataFrame([(7, "a b c d")], "i long, t string")
    got = {r.id: r.t for r in cleaned(docs, "t", ["id"], items, "i", "t").collect()}
    assert got == {1: "before: ! after this and that is fine", 3: None} or got == {1: "before: ! after this and that is fine", 3: ""}


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_all_pairs(spark, corpus):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(50)) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(25)]
    texts = list(ODD_TEXTS)
    for b in base:
        for _ in range(rng.randrange(6)):
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = "new"
            texts.append(" ".join(c).title())
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "lost its id", None, None, None), (3, texts[3], None, None, None)]
    got = QUERIES["op8_near_dedup"](spark, corpus([], rows=rows)).collect()
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_warc_round_trip(spark, corpus):
    long = "long é " * 9000
    rows = [(1, "http://a/ b", "x" * 200), (2, None, "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "v", long), (0, "w", "WARC/1.1\r\n\r\n0\r\n\r\n" * 9), (2, "again", "x" * 200)]
    folder = corpus([], "pages", "page_id long, url string, html string", rows)
    got = QUERIES["op6_warc"](spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = db.execute(warc.OP6_SQL).fetchall()
    assert sorted(map(str, got.collect())) == sorted(str(got.sparkSession.createDataFrame([w], got.schema).first()) for w in want)


def test_broken_segments_are_errors():
    body = b"z" * 50_000
    made = list(warc.records(1, "u", body, "id", None, hashlib.sha256(body).hexdigest(), 9000))
    found = list(warc.parsed(b"".join(m + b"\r\n\r\n" for m in made)))
    assert len(found) > 4 and found[-1]["total"] == sum(len(f["block"]) for f in found)
    whole = {**found[0], "parts": [{k: f[k] for k in ("number", "block", "total")} for f in found]}
    warc._whole(whole)
    assert whole["payload"] == body
    with pytest.raises(ValueError, match="segments"):
        warc._whole({**whole, "parts": whole["parts"][:2] + whole["parts"][3:]})


def test_packing_covers_every_piece_once(spark, corpus):
    texts = [*ODD_TEXTS, "word " * 2047, "word " * 2046 + "word", "a b c " * 3000]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op10_packing"](spark, corpus(texts)).toPandas()
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.piece) == list(range(len(own))) and (own.length[1:] == 2048).all()
        for r in own.itertuples():
            raw = b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])
            assert zlib.crc32(raw) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_and_never_overfills(counts):
    used: dict[int, int] = {}
    for pattern, n in plan(counts, 64):
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_quality_learns_from_labels_and_keeps_clean_documents(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgl" for b in "aeiou" for c in "mnrst"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(80)]
        kind = i % 6
        if kind == 0:
            words = [w + "###" for w in words]
        if kind == 1:
            words[rng.randrange(80)] = "insultword"
        rows.append((i, " ".join(words), "en", f"h{i % 7}", 0))
        labels.append((i, int(kind != 0), int(kind == 1)))
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (1001, "", "en", None, 0)], DOCS)
    some = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in judged(docs, some).collect()}
    assert len(got) == 602
    assert sum(got[i].kept == (i % 6 > 1) for i in range(300, 600)) >= 294
    assert judged(docs, some.limit(0)).where("not kept").count() == 0
    assert judged(docs.limit(0), some).count() == 0


def test_sketches_of_few_shingles_keep_the_order_of_rounds():
    from recordloom.llm.near_dedup import sketches

    rng, pairs, size = np.random.default_rng(5), 3000, 144
    four = rng.integers(0, 2**63, (pairs, 4)).astype(np.uint64)
    one = sketches(four[:, :3].ravel(), np.arange(pairs + 1) * 3)
    two = sketches(four.ravel(), np.arange(pairs + 1) * 4)
    late = one >> np.uint64(55)
    assert ((late < size) | (late == size + np.arange(size, dtype=np.uint64))).all()
    unlike = ((one ^ two) & np.uint64(3) != 0).sum(axis=1)
    assert 26 < unlike.mean() < 28
