"""Pairing by rare elements finds every link that pairing in full finds."""

import functools
import itertools
import random

from recordloom.llm import graph, near_dedup


def test_every_link_is_among_the_pairs(spark):
    rng = random.Random(4)
    common = [rng.getrandbits(62) for _ in range(30)]
    sets, base = {}, common[:]
    for node in range(120):
        if node % 4 == 0:
            base = common[: rng.randint(5, 30)] + [rng.getrandbits(62) - (1 << 61) for _ in range(rng.randint(0, 12))]
        sets[node] = set(base[: len(base) - rng.randint(0, 3)] + [rng.getrandbits(62) for _ in range(rng.randint(0, 3))])
    component = {n: n if n % 7 else 0 for n in sets}
    rows = [(n, sorted(s)) for n, s in sets.items() if n != 5] + [(5, sorted(sets[5])[:4]), (5, sorted(sets[5])[3:])]
    members = spark.createDataFrame([(n, component[n]) for n in sets], "node long, component long")
    for percent in (75, 80):
        links = {(a, b) for a, b in itertools.combinations(sets, 2) if component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = {(r.a, r.b) for r in graph._by_rare_elements(members, spark.createDataFrame(rows, "node long, set array<long>"), percent, "true").collect()}
        assert links <= got and all(a < b and component[a] != component[b] for a, b in got) and len(links) > 20


def test_crowded_buckets_give_the_same_components(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=60)
    texts = []
    for i in range(60):  # alike, and in part linked
        own = base[:]
        for k in rng.sample(range(60), rng.choice([1, 2, 5])):
            own[k] = rng.choice(words)
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "id long, text string")
    want = sorted(map(tuple, near_dedup.near_duplicates(df, "text", "id").collect()))
    monkeypatch.setattr(near_dedup, "linked", functools.partial(graph.linked, crowd=3))
    assert sorted(map(tuple, near_dedup.near_duplicates(df, "text", "id").collect())) == want and len({r[2] for r in want}) < 60
