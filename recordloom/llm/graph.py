"""Linked groups: candidate pairs from shared buckets, exact confirmation, and distributed union-find."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import FEW, freed, saved, small


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of the edges (a, b), by contraction.

    In each round every node takes the first node within two steps, in a hashed order that changes with the
    round, and then what that one has taken; edges go between what their ends have taken, and those that have
    become loops go away. A star collapses in one round and a path shrinks by a factor, so there are about as
    many rounds as the logarithm of the longest path, and all but the first work on what is left of the edges.
    Nodes are met by minima of partial aggregates, so a hub costs no more than its edges. Loops and repeated
    edges do no harm.
    """
    left = saved(edges.where("a <> b").select("a", "b").distinct())
    taken = []
    while few := left.count():
        both = left.union(left.select("b", "a")).toDF("u", "v")
        order = [F.struct(F.xxhash64(F.lit(len(taken)), x).alias("h"), F.col(x).alias("x")) for x in ("u", "v")]
        one = saved(both.groupBy("u").agg(F.min(order[1]).alias("first")).select(F.col("u").alias("v"), F.least("first", order[0]).alias("first")))
        two = both.join(small(one, 2 * few), "v").groupBy("u").agg(F.min("first").alias("first"))
        two = saved(two.select(F.col("u").alias("node"), F.col("first.x").alias("x")))
        then = two.select(F.col("node").alias("x"), F.col("x").alias("to"))
        to = saved(two.join(small(then, 2 * few), "x").select("node", "to"))
        taken.append(to)
        then = left
        for end in ("a", "b"):
            then = then.join(small(to.withColumnRenamed("node", end), 2 * few), end).drop(end).withColumnRenamed("to", end)
        then = saved(then.where("a <> b").select("a", "b").distinct())
        freed(left, one, two)
        left = then
    out = taken.pop() if taken else left.toDF("node", "to")
    while taken:
        last, before = out.select(F.col("node").alias("to"), F.col("to").alias("last")), taken.pop()
        now = saved(before.join(small(last, out.count()), "to", "left").select("node", F.coalesce("last", "to").alias("to")))
        freed(out, before)
        out = now
    least = saved(out.groupBy("to").agg(F.min("node").alias("component")))
    found = saved(out.join(small(least), "to").select("node", "component"))
    freed(left, out, least)
    return found


def with_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (node, ...) with their component, themselves where they have no edge."""
    return nodes.join(small(found), "node", "left").withColumn("component", F.coalesce("component", "node"))


#: Longs of 64 parity bits that stand for a set, and as many where all members of a bucket are paired.
PARITY, WIDE = 8, 16


def _sketches(sets: DataFrame, longs: int) -> DataFrame:
    """node, total (number of elements) and the parity bits p0, p1, ... of each set (node, set).

    The bit that an element is hashed to is flipped once by each, so two sets differ in no more bits than elements.
    """
    each = sets.select("node", F.explode("set").alias("e"))
    flips = [F.expr(f"bit_xor(if((e >> 6) & {longs - 1} = {i}, shiftleft(1L, cast(e & 63 as int)), 0L))").alias(f"p{i}") for i in range(longs)]
    return each.groupBy("node").agg(F.count("*").alias("total"), *flips)


def _few_unlike(percent: int, longs: int) -> str:
    """What two linked sets x and y fulfil by their parity bits."""
    unlike = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(longs))
    return f"100 * least(x.total, y.total) >= {percent} * greatest(x.total, y.total) and {100 + percent} * ({unlike}) <= {100 - percent} * (x.total + y.total)"


def _alone(sets: DataFrame) -> DataFrame:
    """node and alone: how many of its elements none of the other sets has; a set that shares all of them has no row."""
    each = sets.select("node", F.explode("set").alias("e"))
    return each.groupBy("e").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))


def shared_elements(sets: DataFrame) -> DataFrame:
    """node, total, common and p0..p7 of each set (node, set).

    common: how many of its elements another of the sets has too; no link can have more in common.
    """
    both = _sketches(sets, PARITY).join(_alone(sets), "node", "left")
    return both.withColumn("common", F.col("total") - F.coalesce("alone", F.lit(0))).drop("alone")


def _enough(percent: int) -> str:
    return f"{100 + percent} * least(x.common, y.common) >= {percent} * (x.total + y.total)"


def _narrowed(rest: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """Members that share enough elements with any other, and what every link of two of them fulfils."""
    bounds = saved(shared_elements(sets))
    kept = saved(rest.join(small(bounds, few=FEW // 8), "node").where(f"100 * common >= {percent} * total"))
    freed(rest, bounds)
    return kept, f"{_enough(percent)} and {_few_unlike(percent, PARITY)}"


#: Hashes by which leaders of buckets are picked, and the share (one in so many) of buckets that are paired in full before the others.
LEADERS, SHARE = 3, 4


def linked(
    buckets: DataFrame, nodes: DataFrame, content_of: Callable[[DataFrame], DataFrame], percent: int,
    near: str = "true", looked_at: list[str] | None = None, alike: Callable[[DataFrame], DataFrame] | None = None, given: DataFrame | None = None, rounds: int = 2, sets_of: Callable[[DataFrame], DataFrame] = lambda content: content, crowd: int = 0,
    bits_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components (node, component) of the links among nodes that share a bucket.

    Nodes are linked if the Jaccard similarity of their sets is percent/100 or more. buckets: key, node;
    nodes: node, the columns `looked_at` that `near` (a condition on nodes x and y that every link fulfils)
    looks at, and whatever content_of needs. content_of takes some of the nodes and gives (node, content); sets_of makes (node, set) of that, where
    the content is not the set; bits_of makes what `_sketches` makes of the sets. given are links (a, b) known beforehand.

    Every node meets only two of each of its buckets, picked by one of LEADERS hashes, so a bucket of any size
    gives twice as many pairs as it has members, and the buckets of a large group have some leaders in common. Only buckets that still hold nodes
    of different components go on. Each of their members meets up to `rounds` times two other leaders, for as long as that finds links, where bits of their
    whole sets allow a link. With `crowd`, what then still shares a bucket without a common component is paired in full where parity bits allow a link: that tests
    as many pairs as buckets hold, in place, and puts out few; larger buckets are cut in pieces of `crowd` members, so that no task holds more. Without, bounds from the
    sets leave out members that can have no link, and the rest is paired by its rare elements, whatever its bucket.
    """
    keys = saved(buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"))
    rest = buckets.join(small(keys), "key").withColumn("component", F.col("node"))
    rest = saved(rest.join(nodes.select("node", *looked_at), "node") if looked_at else rest)
    freed(keys)
    found = None

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links; what they read of a node comes in one scan."""
        pairs = saved(pairs.distinct())
        wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        content = saved(content_of(nodes.join(small(wanted), "node", "left_semi")))
        one, two = content.toDF("a", "x"), content.toDF("b", "y")
        read = one.join(small(pairs), "a").join(two, "b").select("a", "b", "x", "y")
        both = F.size(F.array_intersect("x", "y"))
        links = saved(alike(read) if alike else read.where((100 + percent) * both >= percent * (F.size("x") + F.size("y"))).select("a", "b"))
        freed(pairs, wanted, content)
        return links

    def merged(more: DataFrame) -> DataFrame:
        """Components after more links, which go between the components found so far."""
        if found is None:
            return components(more)
        for end in ("a", "b"):
            now = found.select(F.col("node").alias(end), "component")
            more = more.join(small(now, found.count()), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        wider = components(more)
        every = found.union(wider.select("node", "node")).distinct()
        last = wider.select(F.col("node").alias("component"), F.col("component").alias("last"))
        now = saved(every.join(small(last, wider.count()), "component", "left").select("node", F.coalesce("last", "component").alias("component")))
        freed(found, wider)
        return now

    def open_members() -> DataFrame:
        """Members of the buckets that hold more than one component."""
        now = saved(with_components(rest.drop("component"), found))
        mixed = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        mixed = saved(mixed.select("key"))
        still = saved(now.join(small(mixed), "key"))
        freed(rest, now, mixed)
        return still

    def in_full(rest: DataFrame, near: str) -> DataFrame:
        """Pairs (a, b) of all members of each bucket that `near` allows; of larger buckets than `crowd`, pieces of so many meet all members."""
        large = saved(rest.groupBy("key").agg(F.count("*").alias("common")).where(F.col("common") > crowd))
        ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
        each = rest.join(small(large.select("key")), "key", "left_anti")
        pairs = each.alias("x").join(each.alias("y"), "key").where(f"x.component < y.component and {near}").select(*ends)
        if large.isEmpty():
            return pairs
        cut = rest.join(small(large.select("key", F.ceil(F.col("common") / crowd).alias("_cuts"))), "key")
        x = cut.withColumn("_cut", F.pmod(F.xxhash64("node"), "_cuts")).drop("_cuts").alias("x")
        y = cut.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts").alias("y")
        return pairs.union(x.join(y, ["key", "_cut"]).where(f"x.component < y.component and {near}").select(*ends))

    for salt in range(rounds + 1):
        more = confirmed(_met(rest, near, salt))
        if salt and more.isEmpty():
            break
        found = merged(more if salt or given is None else more.union(given.select("a", "b")))
        rest = open_members()
        if rest.isEmpty():
            return found
        if not salt:
            members = saved(rest.select("node").distinct())
            content = content_of(nodes.join(small(members), "node", "left_semi"))
            if crowd:
                bits = saved(bits_of(content) if bits_of else _sketches(sets_of(content).toDF("node", "set"), WIDE))
                sketched = saved(rest.join(small(bits, few=FEW // 16), "node"))
                freed(members, rest, bits)
                rest, near = sketched, f"{near} and {_few_unlike(percent, WIDE)}"
            else:
                content = saved(content)
                sets = sets_of(content).toDF("node", "set")
                freed(members)
                rest, also = _narrowed(rest, sets, percent)
                near = f"{near} and {also}"
    if crowd:
        for some in (f"pmod(key, {SHARE}) = 0", "true"):  # links of some buckets bring large groups together, and spare the others their pairs
            more = confirmed(in_full(rest.where(some), near))
            if not more.isEmpty():
                found = merged(more)
                rest = open_members()
        freed(rest)
        return found
    members = saved(rest.drop("key").dropDuplicates(["node"]))
    more = confirmed(_by_rare_elements(members, sets.join(small(members.select("node")), "node", "left_semi"), percent, near))
    found = found if more.isEmpty() else merged(more)
    freed(content)
    return found


def _by_rare_elements(members: DataFrame, sets: DataFrame, percent: int, near: str) -> DataFrame:
    """Pairs (a, b) of members of different components that may be linked, by the rarest elements of their sets.

    With the elements of each set in one order, the rarest first, two linked sets share one among the first of the smaller set,
    as many as it may have beyond what a link needs of it, and the first of the larger one. So members of large groups
    that are alike but not linked meet only where they share what few others have, and not through what the group
    has in common. Elements that only one member has count as its rarest and meet nobody.
    """
    own = saved(members.select("node").join(sets, "node").select("node", F.explode("set").alias("e")))
    often = own.groupBy("e").agg(F.count("*").alias("n"))
    listed = own.join(often, "e").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("n", "e"))).alias("l"))
    size = F.size("l")
    probe = F.expr(f"size(l) - cast(({percent} * size(l) + 99) div 100 as int) + 1")
    index = F.expr(f"size(l) - cast(({2 * percent} * size(l) + {99 + percent}) div {100 + percent} as int) + 1")
    first = listed.select("node", size.alias("_size"), index.alias("_index"), F.posexplode(F.slice("l", F.lit(1), probe)).alias("_at", "_e")).where("_e.n > 1")
    first = saved(first.select("node", "_size", (F.col("_at") < F.col("_index")).alias("_few"), F.col("_e.e").alias("_e")).join(small(members, few=FEW // 8), "node"))
    x, y = first.where("_few").alias("x"), first.alias("y")
    smaller = f"(x._size, x.node) < (y._size, y.node) and 100 * x._size >= {percent} * y._size"
    pairs = saved(x.join(y, "_e").where(f"x.component <> y.component and {smaller} and {near}").select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")))
    freed(own, first)
    return pairs


def _met(rest: DataFrame, near: str, salt: int) -> DataFrame:
    """Pairs (a, b) of each member with two leaders of its bucket that are in another component."""
    turn = F.pmod("key", F.lit(LEADERS))
    order = F.struct(F.xxhash64(F.lit(salt), turn, "component"), F.xxhash64(F.lit(salt), turn, "node"), "node")
    each = rest.select("key", order.alias("o"), F.struct(*[c for c in rest.columns if c != "key"]).alias("y"))
    heads = each.groupBy("key").agg(F.min_by("y", "o").alias("low"), F.max_by("y", "o").alias("high"))
    heads = saved(heads.select("key", F.explode(F.array("low", "high")).alias("x")))
    met = each.join(small(heads, few=FEW // 8), "key").where(f"x.component <> y.component and {near}")
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
