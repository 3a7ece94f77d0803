"""Merkle manifest of a dataset, and octopus multiproofs of its rows."""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._ranks import ranked
from ._skew import met
from ._store import importable, saved, small

#: Children of a node, and how many levels of nodes a leaf partition derives by itself.
FAN, LEVELS = 8, 4
#: Consecutive nodes of a tree that form one leaf partition.
BLOCK = FAN**LEVELS
#: The tree whose leaves are the subroots.
TOP = -1


def leaf(columns: list[str | Column]) -> Column:
    """SHA-256 of the values: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def hashed(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def missing(held: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level, the nodes that the proofs of the held leaves need and the held leaves don't give.

    held: sorted positions in a tree of `size` leaves. Whatever can be derived from held leaves or from nodes
    named at a level below is left out, and a node that many proofs need is named once.
    """
    level = 0
    while size > 1:
        parents = np.unique(held // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(children[children < size], held, assume_unique=True)
        held, size, level = parents, -(-size // FAN), level + 1


def _grown(rows: DataFrame) -> DataFrame:
    """All nodes (tree, level, idx, digest, size) above the rows, which are the nodes of level 0. size: nodes of the level.

    A task takes BLOCK consecutive nodes and derives up to LEVELS levels; what comes out on top is the input of
    the next round, so there are a LEVELS-th of as many rounds as levels and the first one holds all the work.
    """
    importable(rows.sparkSession)
    schema = pa.schema([("tree", pa.int64()), ("level", pa.int64()), ("idx", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, level, size = (table[c][0].as_py() for c in ("tree", "level", "size"))
        first, digests = table["idx"][0].as_py(), table["digest"].to_pylist()
        out: tuple[list, ...] = ([], [], [], [])
        for _ in range(LEVELS):
            if size == 1:
                break
            digests = [hashed(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
            first, size, level = first // FAN, -(-size // FAN), level + 1
            for column, x in zip(out, ([level] * len(digests), range(first, first + len(digests)), digests, [size] * len(digests)), strict=True):
                column.extend(x)
        return pa.table([[tree] * len(out[0]), *out], schema=schema)

    found, level = None, 0
    while True:
        grouped = rows.where("size > 1").withColumn("_block", F.expr(f"idx div {BLOCK}")).groupBy("tree", "_block")
        nodes = saved(grouped.applyInArrow(block, "tree long, level long, idx long, digest string, size long"))
        found, level = nodes if found is None else found.union(nodes), level + LEVELS
        rows = nodes.where((F.col("level") == level) & (F.col("size") > 1))
        if rows.isEmpty():
            return found


def manifest(df: DataFrame, row_id: str, tree: str, digest: Column, claimed: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """leaves (id, tree, idx, digest, size, claimed), nodes (tree, level, idx, digest, size) and trees (tree, name, subroot).

    The rows of each value of the column `tree` ascend by id (null first; equal ids by digest) and are the leaves of a
    tree; while several nodes remain, each FAN consecutive ones become one. The subroots, ordered by name (null
    first), grow the tree TOP, whose last node is the root. claimed is carried along: what a holder says
    that the row's digest is. Only ids and digests are shuffled; trees of any size are cut into leaf partitions.
    """
    digests = df.select(F.col(row_id).alias("id"), F.col(tree).alias("name"), digest.alias("digest"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    placed = saved(ranked(digests, ["id", "digest", "claimed"], ["name"], "idx"))
    names = ranked(placed.groupBy("name").agg(F.count("*").alias("size")), ["name"], name="tree")
    names = saved(names)
    leaves = saved(placed.alias("p").join(small(names).alias("n"), F.expr("p.name <=> n.name")).select("id", "tree", "idx", "digest", "size", "claimed"))
    start = leaves.select("tree", F.lit(0).cast("long").alias("level"), "idx", "digest", "size")
    inner = _grown(start)
    ends = saved(inner.union(start).where("size = 1").select("tree", F.col("digest").alias("subroot")))
    trees = saved(names.join(small(ends), "tree").select("tree", "name", "subroot"))
    tops = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(trees.count()).cast("long").alias("size"))
    return leaves, inner.union(tops).union(_grown(tops)), trees


def proofs(wanted: DataFrame, leaves: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of the wanted leaves (rows of `leaves`, all or some).

    Each leaf partition names the least set of nodes that it lacks for all its proofs together, which one join fetches;
    it then derives the interior nodes that its proofs share and expands each leaf's proof by itself. A
    partition is at most BLOCK leaves and FAN - 1 fetched nodes a level for each path that leaves it.
    """
    importable(wanted.sparkSession)
    cut = wanted.withColumn("block", F.expr(f"idx div {BLOCK}"))

    def lacks(table: pa.Table) -> pa.Table:
        tree, at, size = table["tree"][0].as_py(), table["block"][0].as_py(), table["size"][0].as_py()
        own = [(tree, level, idx) for level, idx in missing(np.sort(table["idx"].to_numpy()), size)]
        own += [(TOP, level, idx) for level, idx in missing(np.array([tree]), trees)]
        many = [len(idx) for _, _, idx in own]
        n = sum(many)
        idx = np.concatenate([x for _, _, x in own]) if own else np.zeros(0, np.int64)
        names = ["of", "block", "tree", "level", "idx"]
        return pa.table([np.full(n, tree), np.full(n, at), *(np.repeat(np.array([x[k] for x in own], np.int64), many) for k in (0, 1)), idx], names=names)

    asked = saved(cut.select("tree", "block", "idx", "size").groupBy("tree", "block").applyInArrow(lacks, "of long, block long, tree long, level long, idx long"))
    least = asked.where(f"tree <> {TOP}").agg(F.min("level")).first()[0]
    have = nodes.where(f"tree = {TOP} or level >= {least or 0}").select("tree", "level", "idx", "digest")
    if least == 0:  # some leaves of a partition are not wanted, and their digests are asked for
        have = have.union(leaves.select("tree", F.lit(0).cast("long"), "idx", "digest"))
    fetched = saved(met(asked, have, ["tree", "level", "idx"]))

    def expanded(own: pa.Table, given: pa.Table) -> pa.Table:
        if not len(own):
            raise ValueError("nodes were fetched for no leaf")
        tree, size = own["tree"][0].as_py(), own["size"][0].as_py()
        table = {(t, level, i): x for t, level, i, x in zip(*(given[c].to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True)}
        at, digests, claims = (own[c].to_pylist() for c in ("idx", "digest", "claimed"))
        table |= {(tree, 0, i): x for i, x in zip(at, digests, strict=True)}
        sides: list[dict[int, tuple[str, str]]] = []  # what stands left and right of a node in its run, level by level
        ends = []
        for t, n, held in ((tree, size, sorted(at)), (TOP, trees, [tree])):
            level = 0
            while n > 1:
                beside, parents = {}, sorted({i // FAN for i in held})
                for p in parents:
                    run = [table[t, level, i] for i in range(p * FAN, min(p * FAN + FAN, n))]
                    for k in range(len(run)):
                        beside[p * FAN + k] = ("".join(run[:k]), "".join(run[k + 1 :]))
                    table[t, level + 1, p] = hashed(run)
                sides.append(beside)
                held, n, level = parents, -(-n // FAN), level + 1
            ends.append(table[t, level, held[0]])
            table[TOP, 0, tree] = ends[0]
        subroot, root = ends
        turn = _height(size)  # from there on the path is the tree's own, in the tree of subroots
        out: tuple[list, ...] = ([], [])
        for i, digest, claim in zip(at, digests, claims, strict=True):
            proof, now, where = [], claim or digest, i
            for level, beside in enumerate(sides):
                if level == turn:
                    where = tree
                left, right = beside[where]
                proof += (left, right)
                now = hashed([left, now, right])
                where //= FAN
            out[0].append(hashed(proof))
            out[1].append(now)
        n = len(at)
        return pa.table(
            [own["id"], own["digest"], [subroot] * n, [root] * n, out[0], out[1], [x == root for x in out[1]]],
            names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )

    kind = wanted.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return cut.groupBy("tree", "block").cogroup(fetched.groupBy("of", "block")).applyInArrow(expanded, schema)


def _height(size: int) -> int:
    """Levels above the leaves of a tree."""
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def verified_rows(df: DataFrame, row_id: str, tree: str, columns: list[str], claimed: list[str | Column] | None = None) -> DataFrame:
    """row_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of df.

    columns are what a row's digest covers; claimed the same columns as somebody says they are (none: as
    they are). Nulls in any column are digested as `-`; null ids stand first in their tree, null trees are a
    tree of their own; rows that share an id, equal ones too, are leaves each; an empty table gives no rows. Other
    columns of df are not looked at; an id column named like a new one is refused.
    """
    if row_id in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"):
        raise ValueError(f"the id column is named like a new column: {row_id}")
    leaves, nodes, trees = manifest(df, row_id, tree, leaf(columns), leaf(claimed) if claimed else None)
    return proofs(leaves, leaves, nodes, trees.count()).withColumnRenamed("id", row_id)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower).otherwise(F.col("text"))
    return verified_rows(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], ["doc_id", "source", "lang", "n_chars", text])


#: Nodes of the trees of languages (tree 0 and up) and of the tree of subroots (-1), then each row's way up through both.
OP13_SQL = """
WITH RECURSIVE
d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents),
-- the CRC-32 of the id's digits, four bits at a time; fixed values: its table
nibbles AS (SELECT [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS t),
k AS (
  SELECT d.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(id) * 2), lambda i: CASE WHEN i % 2 = 0 THEN CAST(ascii(id[i // 2 + 1]) AS BIGINT) ELSE 0 END)),
    lambda r, b: xor(xor(r, b) >> 4, t[(xor(r, b) & 15) + 1])), 4294967295) AS crc FROM d, nibbles),
f AS (
  SELECT doc_id, lang, crc, text,
    coalesce(octet_length(encode(id)) || ':' || id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head FROM k),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claimed FROM f),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM l),
up AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, size FROM p
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), max((size + 7) // 8) FROM up WHERE size > 1 GROUP BY tree, level, idx // 8),
s AS (SELECT tree, digest AS subroot FROM up WHERE size = 1),
top AS (
  SELECT -1 AS tree, 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), max((size + 7) // 8) FROM top WHERE size > 1 GROUP BY tree, level, idx // 8),
n AS (SELECT * FROM up UNION ALL SELECT * FROM top),
-- each row at every node of its way: where it stands, what it makes of its own claim, the siblings so far
way AS (
  SELECT doc_id, tree AS own, tree, 0 AS level, idx, size, claimed AS digest, '' AS siblings FROM p
  UNION ALL
  SELECT w.doc_id, w.own, CASE WHEN w.size > 1 THEN w.tree ELSE -1 END, CASE WHEN w.size > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.size > 1 THEN w.idx // 8 ELSE w.own END, CASE WHEN w.size > 1 THEN (w.size + 7) // 8 ELSE (SELECT count(*) FROM s) END,
    CASE WHEN w.size > 1 THEN sha256(b.l || w.digest || b.r) ELSE w.digest END, CASE WHEN w.size > 1 THEN w.siblings || b.l || b.r ELSE w.siblings END
  FROM way w LEFT JOIN (
    SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM n) b
    ON b.tree = w.tree AND b.level = w.level AND b.idx = w.idx
  WHERE w.size > 1 OR w.tree >= 0)
SELECT p.doc_id, p.leaf, s.subroot, root.digest AS root, sha256(w.siblings) AS proof_sha256, w.digest AS folded_root, w.digest = root.digest AS verified
FROM p JOIN s USING (tree) JOIN way w ON w.doc_id = p.doc_id AND w.tree = -1 AND w.size = 1 CROSS JOIN (SELECT digest FROM top WHERE size = 1) root
"""
