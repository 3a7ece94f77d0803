"""Operators 2, 3 and 5 against plain Python."""

import re
import zlib
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from recordloom.llm import packing
from recordloom.llm.queries import QUERIES
from recordloom.llm.sharding import interleave
from recordloom.llm.token_counts import Merges, token_counts

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, corpus):
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, corpus(ODD_TEXTS)).collect()}
    lib = Tokenizer.from_file(PATH)
    for i, t in enumerate(ODD_TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the'sé東1 \n\t !<|>"), max_size=40), max_size=6))
def test_merging_equals_the_library_on_random_texts(texts):
    from recordloom.llm._pretokens import Memo

    lib, memo = Tokenizer.from_file(PATH), Memo(MERGES.counts, 50)
    assert [sum(r) for r in memo.rows(texts)] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


MERGES = Merges(PATH)


def test_token_counts_of_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, "a b", 5, 7)], "id long, _t string, n_extra int, text_ int")
    assert token_counts(df.limit(0), "_t", ["id"], PATH).count() == 0
    assert token_counts(df, "_t", ["id", "n_extra"], PATH).collect()[0].asDict() == {"id": 1, "n_extra": 5, "n_bytes": 3, "n_tokens": 2}


def test_shards_obey_the_law_of_rows_and_keep_the_mixture(spark, corpus):
    rows = [(i, f"t{i}", "en", None if i % 10 == 9 else f"s{(i % 10) // 4}", 1) for i in range(1003)] + [(5, "t5", "en", "s1", 1)]
    got = QUERIES["op3_sharding"](spark, corpus([], rows=rows)).toPandas()
    assert len(got) == 1004
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    shares = got.fillna({"source": "?"}).groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert (shares.max() - shares.min()).max() <= 2
    assert dict(zip(got.doc_id, got.text_crc32, strict=True))[7] == zlib.crc32(b"t7") and set(got["size"]) == {18, 19, 20, 21}


def test_sharding_of_odd_texts_and_of_no_rows(spark, corpus):
    got = QUERIES["op3_sharding"](spark, corpus(ODD_TEXTS)).toPandas()
    assert sorted(got.doc_id) == list(range(len(ODD_TEXTS))) and got.grown_shard.isna().all()
    assert interleave(spark.createDataFrame([], "doc_id long, source string"), "source", "doc_id", 4).count() == 0


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_repetition_equals_plain_counts(spark, corpus):
    texts = [*ODD_TEXTS, *("ab ba ab ba ab"[i:] + "\n" + "c d e f " * i for i in range(12))]
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, corpus(texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_a_text_that_repeats_long_passages_is_not_kept(spark, corpus):
    fresh = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    twice = " ".join(f"v{i}" for i in range(200)) + "\n" + " ".join(f"v{i}" for i in range(40))
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, corpus([fresh, twice])).collect()}
    assert got[0].kept and not got[1].kept and not got[1].base_failed


def test_packing_plans_by_fitted_patterns(monkeypatch):
    left_over = []
    monkeypatch.setattr(packing, "best_fit", lambda left, size, plain=packing.best_fit: (left_over.append(int(left.sum())), plain(left, size))[1])
    wide = {n: 20 + n % 7 for n in range(1100, 1901)}
    sequences = packing.plan(wide, 2048)
    assert max(left_over) < sum(wide.values())
    used = Counter()
    for pattern, times in sequences:
        assert sum(pattern) <= 2048
        for n in pattern:
            used[n] += times
    assert used == wide


def test_encoder_gives_the_ids_of_the_library():
    from recordloom.llm._pretokens import encoder

    lib, own = Tokenizer.from_file(PATH), encoder(PATH)
    odd = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(0x80, 0x3000, 7)]
    for t in [*(x or "" for x in ODD_TEXTS), *odd, "x" * 100_000]:
        assert own(t).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t[:60])
    word = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(word)("Two words").tolist() == Tokenizer.from_file(word).encode("Two words", add_special_tokens=False).ids


def test_rounding_keeps_patterns_of_several_documents_on_small_input():
    rng = __import__("random").Random(3)
    counts = Counter(rng.randint(200, 1500) for _ in range(400))
    sequences = packing.plan(counts, 2048)
    whole = [p for p, _ in sequences if len(p) > 1 and sum(p) == 2048]
    assert len(whole) > 20
    assert sum(n for _, n in sequences) <= 1.03 * sum(k * v for k, v in counts.items()) / 2048 + 1
