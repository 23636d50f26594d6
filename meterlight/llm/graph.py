"""Connected components of edge tables, and of links between rows that share buckets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm import scratch

#: Keys of a bucket up to which all of them lead at once, so a key meets at most so many.
SMALL = 64
#: Times more leaders of a bucket in each round; rounds after which buckets are dealt anew.
GROWTH, DEALS = 64, 2


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (src, dst); root is the least node
    of its component.

    Each round points nodes at their least neighbour, follows the pointers to
    the ends, and replaces the edges by edges between ends; every table is keyed
    by single nodes, minima are summed up before shuffling, and a round's tables
    are written, so hot nodes and lost executors cost little. Edges may repeat;
    self-loops make a node of its own; nulls are left out. No edges: no rows.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    current = scratch.save(both, "edges")
    found = None
    while True:
        near = scratch.Near(current)
        up = current.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("root"))
        up = near.save(up, "pointers")
        while True:
            jump = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            moved = near.save(up.join(near(jump), "root", "left").select("node", "root", F.coalesce("end", "root").alias("end")), "jumps")
            changed = moved.where("end <> root").limit(1).count()
            scratch.discard(up)
            up = moved.select("node", F.col("end").alias("root"))
            if not changed:
                break
        if found is None:
            total = up
        else:
            ends = up.select(F.col("node").alias("root"), F.col("root").alias("end"))
            total = scratch.save(found.join(near(ends), "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels")
        found = total
        a = up.select(F.col("node").alias("src"), F.col("root").alias("s"))
        b = up.select(F.col("node").alias("dst"), F.col("root").alias("d"))
        left = current.join(near(a), "src").join(near(b), "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
        following = near.save(left, "edges")
        scratch.discard(current)
        current = following
        if not current.limit(1).count():
            return found


def connect(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], DataFrame] | None = None, percent: int = 80) -> DataFrame:
    """(node, root) of the keys that are linked with others; buckets are (band, key),
    and ``verify`` keeps the links of pairs (src, dst). No pair of a bucket that could
    still connect two components is left out.

    First each key meets one hub, the key of its buckets that shares most buckets with
    others. Buckets that still hold several components then compare their keys with
    leaders, which leave the bucket: all keys, if they are at most ``SMALL``, else one
    hub, and ``GROWTH`` times more in each round, those outside the largest component first.

    ``refine`` deals such buckets anew: of rows (key, root, lead) it makes rows (band,
    key, root, ask, n, i, e, lead), smaller buckets in which every pair meets that can
    still be a link, given how both compare with the hub ``lead``, and one row without
    a band for each row it was given. ``ask`` marks keys that aren't linked with the hub,
    of which any such pair has one; n and i are a key's size and its overlap with the
    hub, e what keys of the bucket may share outside it, for links of at least ``percent`` of the union in common. It deals all buckets
    after the first round, by the best hub of their keys, and later those that a hub
    of theirs explains better. So n keys around one hub cost about n pairs.
    """
    active = buckets.select("band", "key", F.col("key").alias("root"), F.lit(True).alias("ask"), *[F.lit(None).cast("long").alias(c) for c in ("n", "i", "e")])
    roots = None
    for turn in count():
        near = scratch.Near(active)
        leaders = near.save(leading(active, turn, near), "leaders")
        met = active.join(near(leaders), "band")
        if turn:
            met = met.where("root <> lead_root and (ask or lead_ask) and (not every or key < lead)")
            # Both are known against one hub: an overlap is at most that inside it and that outside.
            common = F.least("i", "lead_i") + F.least("e", "lead_e")
            met = met.where(F.coalesce((100 + percent) * common >= percent * (F.col("n") + F.col("lead_n")), F.lit(True)))
        else:
            hubs = near.save(met.groupBy("key").agg(F.max(F.struct("weight", "lead")).alias("hub")), "hubs")
            met = hubs.select("key", "hub.lead").where("key <> lead")
        pairs = near.save(met.select(F.least("key", "lead").alias("src"), F.greatest("key", "lead").alias("dst")).distinct(), "pairs")
        new = scratch.save(verify(pairs), "links")
        roots = joined(roots, new)
        rest = active
        if turn:
            rest = rest.join(near(leaders.where("every").select("band")), "band", "left_anti")
            rest = rest.join(near(leaders.where("not every").select("band", F.col("lead").alias("key"))), ["band", "key"], "left_anti")
        rest = near.save(relabelled(rest, roots), "rest")
        left = near.save(rest.join(near(undecided(rest)), "band", "left_semi"), "left")
        following = left
        if refine and turn < DEALS and left.limit(1).count():
            best = left.join(near(hubs), "key").select("band", "hub") if not turn else leaders.select("band", F.struct("weight", "lead").alias("hub"))
            members = left.join(near(best.groupBy("band").agg(F.max("hub").alias("hub")).select("band", "hub.lead")), "band")
            members = near.save(members, "members")
            dealt = scratch.save(refine(members.select("key", "root", "lead").distinct()), "dealt")
            known = dealt.where("band is null")
            roots = joined(roots, known.where("not ask and key <> lead").select(F.col("key").alias("src"), F.col("lead").alias("dst")))
            if turn:
                now = known.select("key", "lead", F.col("i").alias("now"))
                better = members.join(near(now), ["key", "lead"]).groupBy("band").agg(F.sum("now").alias("now"), F.sum("i").alias("was")).where("now > was").select("band")
                following = relabelled(left.join(near(better), "band", "left_anti"), roots)
                wanted = members.join(near(better), "band", "left_semi").select("key", "lead").distinct()
                dealt = dealt.join(near(wanted), ["key", "lead"], "left_semi")
            else:
                following = relabelled(left.where("false"), roots)
            fresh = dealt.where("band is not null").groupBy("band", "key").agg(F.max("root").alias("root"), F.max("ask").alias("ask"), *[F.max(c).alias(c) for c in ("n", "i", "e")])
            sized = scratch.Near(dealt)
            fresh = sized.save(relabelled(fresh, roots), "fresh")
            following = following.unionByName(fresh.join(sized(undecided(fresh)), "band", "left_semi").select(*following.columns))
        following = scratch.save(following.select("band", "key", "root", "ask", "n", "i", "e"), "active")
        for table in (leaders, pairs, new, rest, left):
            scratch.discard(table)
        active = following
        if not active.limit(1).count():
            return roots


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links (src, dst) between nodes: components of
    what the links join, which are few once most links are known."""
    if roots is None:
        return components(links)
    if not links.limit(1).count():
        return roots
    near = scratch.Near(links)
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    up = near.save(nodes.join(roots.join(near(nodes), "node", "left_semi"), "node", "left").select("node", "root"), "up")
    of = up.select("node", F.coalesce("root", "node").alias("end"))
    ends = links.join(near(of.toDF("src", "s")), "src").join(near(of.toDF("dst", "d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    more = components(ends)
    known = roots.join(near(more.toDF("root", "end")), "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    fresh = more.join(near(up.where("root is null").select("node")), "node", "left_semi").select("node", "root")
    return scratch.save(known.unionByName(fresh), "roots")


def relabelled(active: DataFrame, roots: DataFrame) -> DataFrame:
    own = scratch.Near(roots)(roots).withColumnRenamed("node", "key")
    return active.drop("root").join(own, "key", "left").withColumn("root", F.coalesce("root", "key"))


def undecided(active: DataFrame) -> DataFrame:
    """The bands of several components, with a key that asks."""
    return active.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("ask").alias("c")).where("a <> b and c").select("band")


def leading(active: DataFrame, turn: int, near: scratch.Near) -> DataFrame:
    """(band, lead, lead_root, lead_ask, lead_n, lead_i, lead_e, weight, every): the leaders of
    each bucket; ``every`` marks buckets all of whose keys lead."""
    sizes = active.groupBy("band").agg(F.count("*").alias("size"), F.count_if("ask").alias("askers"))
    sized = active.join(near(sizes), "band")
    known = sized.join(near(sized.groupBy("key").agg(F.sum("size").alias("weight"))), "key")
    if turn:
        shares = active.groupBy("band", "root").agg(F.count("*").alias("share"))
        largest = shares.groupBy("band").agg(F.max_by("root", F.struct("share", "root")).alias("major"))
        known = known.join(near(largest), "band").withColumn("every", F.col("size") <= SMALL)
    else:
        known = known.withColumns({"major": F.lit(None).cast("binary"), "every": F.lit(False)})
    # Once all keys outside one component have led, what is left is one component.
    late = turn > 1
    slot = F.pmod(F.xxhash64(F.lit(turn), "key"), F.lit(GROWTH ** max(0, turn - 1)))
    order = F.struct((F.col("ask") & (F.col("askers") == 1)).alias("alone"), (F.lit(late) & (F.col("root") != F.col("major"))).alias("outside"), "weight", "key")
    columns = ["key", "root", "ask", "n", "i", "e", "weight", "every"]
    picked = known.where("not every").groupBy("band", slot.alias("slot")).agg(F.max_by(F.struct(*columns), order).alias("x")).select("band", "x.*")
    picked = picked.unionByName(known.where("every").select("band", *columns))
    return picked.select("band", F.col("key").alias("lead"), F.col("root").alias("lead_root"), F.col("ask").alias("lead_ask"), *[F.col(c).alias(f"lead_{c}") for c in ("n", "i", "e")], "weight", "every")
