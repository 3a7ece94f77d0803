"""The pipeline against plain Python: line dedup, near copies, benchmark passages and packing, one after the other."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def merged(sets, percent):
    """The first of each group of sets linked by their Jaccard similarity, by all pairs."""
    label = list(range(len(sets)))
    while True:
        before = list(label)
        for i in range(len(sets)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def without_lines(texts):
    at, sets = [], []
    for i, t in sorted(texts.items()):
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                at.append((i, k))
                sets.append({line[p : p + 5] for p in range(max(1, len(line) - 4))})
    gone = {at[i] for i, first in enumerate(merged(sets, 80)) if first != i}
    out = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    return {i: t for i, t in out.items() if not (texts[i] or "").strip() or t.strip()}


def without_copies(texts):
    ids = sorted(texts)
    words = [(texts[i] or "").lower().split() for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    return {ids[i]: texts[ids[i]] for i, first in enumerate(merged(sets, 75)) if first == i}


def without_items(texts, items):
    windows = {tuple(w[k : k + 10]) for w in (WORD.findall(x.lower().encode()) for x in items) for k in range(max(1, len(w) - 9))}
    out = {}
    for i, t in texts.items():
        raw = (t or "").encode()
        at = [(m.start(), m.end()) for m in WORD.finditer(raw.lower())]
        own = [raw.lower()[a:b] for a, b in at]
        hit = {k + d for k in range(len(own)) for w in windows if tuple(own[k : k + len(w)]) == w for d in range(len(w))}
        if 2 * len(hit) > len(own):
            continue
        ends = [k for k in sorted(hit) if k + 1 not in hit]
        for end in reversed(ends):
            start = end
            while start - 1 in hit:
                start -= 1
            raw = raw[: at[start][0]] + raw[at[end][1] :]
        out[i] = raw.decode()
    return out


def tables(spark, folder, texts, items, labels):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n))
    items, shared, base = [prose(25), prose(6)], prose(20), prose(60)
    texts = {i: "\n".join(prose(30) for _ in range(3)) for i in range(12)}
    texts |= {20: f"{prose(40)}\n{shared}\n{prose(9)}", 21: f"{prose(40)}\n{shared}", 22: shared, 23: None, 24: "", 25: " \n"}
    # copies whose lines are cut elsewhere, so that only the document stage can see them
    cut = base.split(" ")
    texts |= {30: " ".join(cut), 31: " ".join(cut[:20]) + "\n" + " ".join(cut[20:]), 32: " ".join(cut[:40]) + "\n" + " ".join(cut[40:] + ["tail"])}
    texts |= {40: f"{prose(40)} {items[0]} {prose(30)}", 41: f"{prose(3)} {items[1].upper()}", 42: f"{prose(30)}, {items[1]}. {prose(5)}"}
    left = without_items(without_copies(without_lines(texts)), items)
    assert 22 not in left and 41 not in left and {30, 31, 32} & set(left) == {30} and {23, 24, 25} <= set(left)
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, tables(spark, tmp_path, texts, items, [])).collect():
        got[r.doc_id].append((r.piece, r.length, r.ids_crc32))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        want[i] = [(0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
    assert dict(got) == want
