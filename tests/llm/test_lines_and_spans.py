"""Operators 1 and 9 and the pipeline against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter

from recordloom.llm.queries import QUERIES

from .conftest import ODD_TEXTS


def test_line_dedup_equals_all_pairs(spark, corpus):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 30]))) for _ in range(12)]
    near = [x.replace("w1", "v1", 1) for x in lines]
    texts = [x for x in ODD_TEXTS if x is None or "\x1c" not in x] + ["\n".join(rng.choice(lines + near) for _ in range(4)) for _ in range(12)]
    got = {r.doc_id: r.n_removed for r in QUERIES["op1_line_dedup"](spark, corpus(texts)).collect()}
    want = {i: len(gone) for i, gone in removed_by_every_position(texts).items()}
    assert want and len(got) == len(texts) and {k: v for k, v in got.items() if v} == want


def test_repeated_spans_equal_plain_windows(spark, corpus):
    rng = random.Random(13)
    block = "".join(rng.choice("abcdé \n") for _ in range(900))
    fresh = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [*ODD_TEXTS, block, fresh(70) + block[100:600] + fresh(30), fresh(500) + block[250:640], block[:399], "ab" * 700, fresh(800)]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[s : s + 400] for x in raw for s in range(len(x) - 399))
    got = {r.doc_id: r for r in QUERIES["op9_repeated_spans"](spark, corpus(texts)).collect()}
    for i, x in enumerate(raw):
        mark = bytearray(len(x))
        for s in range(len(x) - 399):
            if seen[x[s : s + 400]] > 1:
                mark[s : s + 400] = b"\1" * 400
        kept = bytes(b for b, m in zip(x, mark, strict=True) if not m)
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), sum(mark), runs, hashlib.sha256(kept).hexdigest()), i


def every_position(line, k=5):
    return frozenset(line[p : p + k] for p in range(max(1, len(line) - k + 1)))


def removed_by_every_position(texts, percent=80):
    at = [(i, k) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if re.search(r"[^ \t\n\x0b\f\r]", x)]
    sets = [every_position(texts[i].split("\n")[k]) for i, k in at]
    label, before = list(range(len(sets))), None
    while label != before:
        before = list(label)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    gone = {}
    for (i, k), first, own in zip(at, label, range(len(sets)), strict=True):
        if first != own:
            gone.setdefault(i, []).append(k)
    return gone


def removed_by_query(spark, folder):
    rows = QUERIES["op1_line_dedup"](spark, folder).collect()
    return {r.doc_id: [int(x) for x in r.removed_lines.split(",")] for r in rows if r.n_removed}


def test_line_dedup_takes_shingles_at_every_position(spark, corpus):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = [x for x in ODD_TEXTS if x is None or "\x1c" not in x]
    for n in (15, 20, 30):
        for _ in range(8):
            words = [word() for _ in range(n)]
            other = list(words)
            other[rng.randrange(n)] = word()
            texts += [" ".join(words), "first\n" + " ".join(other)]
    want = removed_by_every_position(texts)
    assert sum(map(len, want.values())) > 30
    assert removed_by_query(spark, corpus(texts)) == want


def test_line_dedup_reads_words_to_their_end(spark, corpus):
    rng = random.Random(19)
    khmer = [chr(0x1780 + i) for i in range(34)]
    token = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    stay = ["https://example.org/articles/2021/alpha", "https://example.org/products/9981/omega", "internationalisation", "internationalism"]
    stay += ["data:image/png;" + token("ABCDEFabcdef0123456789+/", 60) for _ in range(3)]
    stay += ["sha256:0000" + token("0123456789abcdef", 48) for _ in range(3)]
    stay += ["one two three " + "prefixprefix" + token("qrstuvwxyz", 30) for _ in range(2)]
    stay += ["".join(khmer[:14]) + token(khmer, 40) for _ in range(3)]
    twice = "https://example.org/a/page/that/occurs/twice/in/this/corpus"
    texts = [*stay, twice, twice + "/", "\n".join(stay[:2])]
    assert removed_by_every_position(texts) == {len(stay) + 1: [0], len(stay) + 2: [0, 1]}
    assert removed_by_query(spark, corpus(texts)) == {len(stay) + 1: [0], len(stay) + 2: [0, 1]}


def test_line_dedup_misses_no_line_with_words_added(spark, corpus):
    rng = random.Random(23)
    texts = []
    for _ in range(400):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(28))
        texts += [line, line + "".join(rng.choice("ABCDEFGHIJ") for _ in range(6))]
    assert removed_by_query(spark, corpus(texts)) == {i: [0] for i in range(1, 800, 2)}


def test_line_dedup_of_short_and_periodic_lines(spark, corpus):
    rng = random.Random(29)
    letters = "abcdefghijklmnopqrstuvwxyz"
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["-" * 20, "-" * 80, "=-" * 11, "=-" * 300, "* * * " * 9, "* * * " * 40, "abc" * 7, "abc" * 90, "word " * 4, "word " * 40]
    for n in (8, 9, 13, 18, 20, 22, 30, 38, 41, 47, 55, 64, 80):
        for _ in range(4):
            line = token(n)
            texts += [line, line + token(max(1, (n - 4) // 4)), token(2) + line]
    assert removed_by_query(spark, corpus(texts)) == removed_by_every_position(texts)


def test_line_dedup_keeps_columns_of_any_name_and_takes_an_empty_table(spark):
    from recordloom.llm.line_dedup import deduplicated, removed_lines

    rows = [(1, "one line of text\nanother line of it", 5, 6, 7), (2, "one line of text", 8, 9, 10), (None, "one line of text", 1, 1, 1), (3, None, 2, 2, 2)]
    df = spark.createDataFrame(rows, "_id long, line string, removed int, _doc int, g1 int")
    got = {r._id: r for r in deduplicated(df, "line", "_id").collect()}
    assert [got[i].line for i in (1, 2, None, 3)] == [rows[0][1], "", rows[2][1], None] and got[2]._doc == 9 and got[2].removed == 8
    assert deduplicated(df.limit(0), "line", "_id").count() == 0 and removed_lines(df.limit(0), "line", "_id").count() == 0
