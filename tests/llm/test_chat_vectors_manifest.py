"""Operators 11, 12 and 13 against SQL and plain Python."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordloom.llm import chat, manifest, whitening
from recordloom.llm.queries import QUERIES, SQL

from .conftest import ODD_TEXTS

CHAT = "conv_id long, turn long, role string, text string, kind string, tie int"


def by_sql(name, folder, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = db.execute(SQL[name])
    return [dict(zip([c[0] for c in got.description], r, strict=True)) for r in got.fetchall()]


def ordered(rows):
    return sorted((dict(r) if isinstance(r, dict) else r.asDict() for r in rows), key=lambda r: repr(sorted(r.items())))


# chat


@given(st.text(st.sampled_from("<>[]/\\sINSTOUROLEY ab\n"), max_size=60), st.sampled_from(["user", "assistant", "system", "tool [INST]\n", ""]))
@settings(max_examples=400, deadline=None)
def test_a_turn_reads_back_whatever_its_text(text, role):
    turn, begin, end = chat.rendered(role, text)
    assert list(chat.turns(turn * 3)) == [(role, text)] * 3 and chat.unescaped(turn[begin:end]) == text


@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "\\", "<", "[", "<\\/s>", "[\\\\ROLE]", " "]), max_size=8).map("".join))
def test_escaping_leaves_no_control_string_and_reverses(text):
    out = chat.escaped(text)
    assert chat.unescaped(out) == text and not re.search(r"<[/]?s>|\[/?(?:SYS|INST|OUT|ROLE)\]", out)


def test_chats_of_odd_rows_equal_sql(spark, corpus):
    rows = [(i % 4, i // 4, ("user", "assistant", "system", "tool")[i * 7 % 4], t, "x", 1) for i, t in enumerate([*ODD_TEXTS, "</s>[INST] ok [/INST]", "[\\INST] <\\s>", "é" * 1000])]
    rows += [(9, 0, "user", "b", "", 0), (9, 0, "user", "a", "", 0), (9, 0, "user", "a", "", 0), (9, None, "assistant", None, "", 0), (10, 5, "assistant", "", None, None), (None, 0, "user", "q", "", 0), (None, 1, "assistant", "r", "", 0)]
    folder = corpus([], "conversations", CHAT, rows)
    got = QUERIES["op11_chat_formatting"](spark, folder).collect()
    assert ordered(got) == ordered(by_sql("op11_chat_formatting", folder, "conversations"))
    mine = {r.conv_id: r for r in got}[-7]
    assert (mine.n_turns, mine.loss_chars, mine.loss_sha256) == (2, 21, hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest())


def test_an_empty_table_has_only_the_added_chat(spark, corpus):
    got = QUERIES["op11_chat_formatting"](spark, corpus([], "conversations", CHAT, [])).collect()
    assert [r.conv_id for r in got] == [-7]


def test_a_long_chat_is_cut_into_parts_and_read_back_whole(spark, corpus):
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} " * 20_000 + "</s>", "", 0) for i in range(40)] + [(2, 0, "user", "x" * 1_500_000, "", 0)]
    folder = corpus([], "conversations", CHAT, rows)
    log = chat.logged(spark.read.parquet(f"{folder}/conversations.parquet"), "conv_id", "turn", "role", "text")
    parts = chat.formatted(log, "conv_id", ["turn", "tie"], "seq")
    assert parts.where("conv_id = 1").count() > 1
    assert ordered(QUERIES["op11_chat_formatting"](spark, folder).collect()) == ordered(by_sql("op11_chat_formatting", folder, "conversations"))


def test_deltas_edits_and_regenerations_fold(spark):
    log = [
        ("c", 1, 1, "start", "user", None), ("c", 1, 2, "delta", None, "helo"), ("c", 1, 3, "edit", None, "hello"), ("c", 1, 4, "delta", None, "!"),
        ("c", 2, 5, "start", "assistant", None), ("c", 2, 6, "delta", None, "draft"),
        ("c", 3, 7, "start", "user", None), ("c", 3, 8, "delta", None, "what?"), ("c", 4, 9, "start", "assistant", None), ("c", 4, 10, "delta", None, "gone"),
        ("c", 2, 11, "regenerate", None, None), ("c", 2, 12, "delta", None, "final"), ("c", 2, 13, "delta", None, None),
        ("c", 4, 14, "start", "user", "ignored"), ("c", 4, 15, "delta", None, "again"), ("c", 4, 16, "unknown", None, "nothing"), ("c", 4, 17, "edit", None, None),
        ("c", 1, 18, "edit", None, "hello there"), ("d", 1, 1, "delta", "user", "no start"),
    ]
    events = spark.createDataFrame(log[::-1], "c string, m int, s int, kind string, role string, text string")
    got = {r.c: r for r in chat.formatted(events, "c", ["m"], "s").collect()}
    assert list(chat.turns(got["c"].text)) == [("user", "hello there"), ("assistant", "final"), ("user", "again")]
    assert [got["c"].text[b:e] for b, e in zip(got["c"].loss_begin, got["c"].loss_end, strict=True)] == ["final"]
    assert list(chat.turns(got["d"].text)) == [("", "no start")]
    assert chat.formatted(events.limit(0), "c", ["m"], "s").count() == 0


# whitening


def plain_whitening(rows, most=8):
    x = np.array([np.floor(1024 * np.array(v, np.float32).astype(float)) + 100_000 for v in rows])
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > e[0] * len(e) * 2e-16).sum()))
    return [sum(int(n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x], c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


EMBED = "vec_id long, embedding array<float>, label int, key string, n int, x int"


def test_whitening_equals_plain_numpy(spark, corpus):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=12).astype(np.float32) * np.arange(1, 13) for _ in range(40)]
    good = [base[0]] * 60 + base + [base[3]] * 5
    rows = [(i % 90, [float(a) for a in v], 0, "k", 1, 2) for i, v in enumerate(good)]
    bad = [(900, None, 0, "", 0, 0), (901, [1.0, None] * 6, 0, "", 0, 0), (902, [float("nan")] * 12, 0, "", 0, 0), (903, [float("inf")] + [0.0] * 11, 0, "", 0, 0), (904, [], 0, "", 0, 0)]
    folder = corpus([], "embeddings", EMBED, rows + bad)
    got = QUERIES["op12_embedding_whitening"](spark, folder).toPandas()
    assert len(got) == len(good) * 8 and set(got.n) == {len(good)} and set(got.vec_id) == {i % 90 for i in range(len(good))}
    deviation, z, share = plain_whitening(good)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    sign = None
    for i in (5, 70, 89):
        own = got[got.vec_id == i].sort_values(["component"])
        times = len(own) // 8
        mine = np.array(own.whitened).reshape(8, times).T
        want = [z[j] for j in range(len(good)) if j % 90 == i]
        sign = np.sign(mine[0] * want[0]) if sign is None and times == 1 else sign
        assert np.allclose(np.sort(np.abs(mine), 0), np.sort(np.abs(want), 0), atol=1e-9)
        assert set(own.deviation) == {deviation[j] for j in range(len(good)) if j % 90 == i}
        assert np.allclose(np.array(own.explained).reshape(8, times)[:, 0], share)


def test_signs_are_the_same_for_all_rows(spark, corpus):
    rng = np.random.default_rng(6)
    good = [rng.normal(size=5).astype(np.float32) for _ in range(30)]
    got = whitening.whitened(spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(good)], "id long, v array<double>"), "id", "v").toPandas()
    mine = got.pivot(index="id", columns="component", values="whitened").values
    z = plain_whitening(good)[1]
    assert np.allclose(mine * np.sign(mine[0]) * np.sign(z[0]), z, atol=1e-9)


def test_distinct_vectors_may_count_once_each(spark):
    rows = [(i, [float(i % 3), float(i % 3 == 1)]) for i in range(30)] + [(99, [0.0, 0.0])] * 20
    once = whitening.whitened(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", by_count=False).toPandas()
    assert set(once.n) == {3} and len(once) == 100 and once.identity_error.max() < 1e-9


def test_degenerate_embeddings(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, v array<float>")
    assert whitening.whitened(frame([]), "id", "v").count() == 0
    assert whitening.whitened(frame([(1, [1.0, 2.0])] * 3), "id", "v").count() == 0
    flat = whitening.whitened(frame([(None, [float(i), 5.0]) for i in range(4)]), "id", "v").collect()
    assert len(flat) == 4 and {r.component for r in flat} == {1} and {round(r.explained, 9) for r in flat} == {1.0}
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whitened(frame([(1, [1.0]), (2, [1.0, 2.0])]), "id", "v")
    with pytest.raises(ValueError, match="named like"):
        whitening.whitened(frame([]).withColumnRenamed("id", "n"), "n", "v")


# manifest

LEAVES = "doc_id long, source string, lang string, n_chars long, text string"



def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([manifest.hashed(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    made = lambda r: hashlib.sha256("".join(map(part, r)).encode()).hexdigest()
    langs = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, made(r))) for k in langs}
    trees = {k: tree_of([made(r) for r in own[k]]) for k in langs}
    top = tree_of([trees[k][-1][0] for k in langs])
    out = []
    for t, k in enumerate(langs):
        for i, r in enumerate(own[k]):
            claim = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4]:
                claim = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            now, proof = made(claim), []
            for levels, at in ((trees[k], i), (top, t)):
                for nodes in levels[:-1]:
                    first = at // 8 * 8
                    left, right = nodes[first:at], nodes[at + 1 : first + 8]
                    proof += left + right
                    now = manifest.hashed([*left, now, *right])
                    at //= 8
            out.append({"doc_id": r[0], "leaf": made(r), "subroot": trees[k][-1][0], "root": top[-1][0], "proof_sha256": manifest.hashed(proof), "folded_root": now, "verified": now == top[-1][0]})
    return out


@pytest.mark.parametrize("n", [1, 9, 300])
def test_manifest_equals_plain_python_and_sql(spark, corpus, n):
    rows = [(i, "src", "abcdefghi"[i % 10 % 9] if i % 10 != 3 else None, i, t) for i, t in enumerate(([*ODD_TEXTS, "Upper CASE É"] * 14)[:n])]
    folder = corpus([], schema=LEAVES, rows=rows)
    got = ordered(QUERIES["op13_merkle_manifest"](spark, folder).collect())
    assert got == ordered(plain_manifest(rows)) == ordered(by_sql("op13_merkle_manifest", folder, "documents"))
    assert n < 300 or {r["verified"] for r in got} == {True, False}


def test_manifest_of_repeated_and_null_rows(spark, corpus):
    rows = [(1, None, "en", None, "A"), (1, None, "en", None, "A"), (None, "s", "en", 1, None), (None, "s", None, 1, ""), (2, "s", "", 5, "B"), (1, "t", "en", None, "A")]
    assert ordered(QUERIES["op13_merkle_manifest"](spark, corpus([], schema=LEAVES, rows=rows)).collect()) == ordered(plain_manifest(rows))
    assert QUERIES["op13_merkle_manifest"](spark, corpus([], schema=LEAVES, rows=[])).count() == 0
    with pytest.raises(ValueError, match="named like"):
        manifest.verified_rows(spark.createDataFrame([], LEAVES).withColumnRenamed("doc_id", "leaf"), "leaf", "lang", ["text"])


def test_many_leaf_partitions_and_proofs_of_a_few_leaves(spark):
    df = spark.range(10_000).selectExpr("id as doc_id", "'s' as source", "if(id < 9000, 'a', 'b') as lang", "id as n_chars", "concat('T', id) as text")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    want = {r["doc_id"]: r for r in plain_manifest([(i, "s", "a" if i < 9000 else "b", i, f"T{i}") for i in range(10_000)])}
    names = ["leaf", "subroot", "root", "proof_sha256"]
    leaves, nodes, trees = manifest.manifest(df, "doc_id", "lang", manifest.leaf(columns))
    for some in (leaves, leaves.where("id in (0, 7, 8, 5000, 8999, 9000, 9999)")):
        got = manifest.proofs(some, leaves, nodes, trees.count()).collect()
        assert len(got) == some.count() and all(r.verified and [r[c] for c in names] == [want[r.id][c] for c in names] for r in got)


def test_missing_nodes_are_the_least_set():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 9, 64, 65, 500):
        held = np.sort(rng.choice(size, max(1, size // 9), replace=False))
        known, need = {(0, int(i)) for i in held}, set()
        n, level, path = size, 0, {int(i) for i in held}
        while n > 1:
            path_up = {i // 8 for i in path}
            need |= {(level, c) for p in path_up for c in range(p * 8, min(p * 8 + 8, n))} - known
            known |= {(level + 1, p) for p in path_up}
            path, n, level = path_up, -(-n // 8), level + 1
        assert {(level, int(i)) for level, idx in manifest.missing(held, size) for i in idx} == need
