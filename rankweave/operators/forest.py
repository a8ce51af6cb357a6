"""Ordered dependencies resolved in parallel: links followed by doubling, folds contracted in their order.

A step of a loop is a join of slim rows and is written, so a path of n steps takes about
log2(n) rounds, whatever its shape, and no task holds a whole path, star or component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop, written

#: Moments of one window of a running aggregate; windows are then put behind each other.
MOMENTS = 1 << 14


def follow(links: DataFrame) -> DataFrame:
    """(node, root) of ``links`` (node, to), written: where the path from each node ends.

    A path ends at a node that points to itself, or that has no row. Nodes are distinct;
    paths have no cycle.
    """
    now = written(links.select("node", F.col("to").alias("root")), "links")
    while True:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        there = written(now.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "links")
        drop(now)
        now = there
        if there.where("moved").isEmpty():
            out = there.select("node", "root")
            out.written_at = there.written_at
            return out


def running(df: DataFrame, key: str, at: str, value: Column, combine, name: str, ties: tuple[str, ...] = (), upto: int = 0) -> DataFrame:
    """``df`` with ``name``: ``value`` combined (``F.max``, ``F.sum``) over the rows of its key up to the row ``upto`` before it, in order of ``at`` (long), then ``ties``.

    A key's rows are cut into spans of ``MOMENTS``, so a key with very many rows is not one task's.
    """
    cut = df.withColumn("__span", F.floor(F.col(at) / MOMENTS)).withColumn("__value", value)
    inside = Window.partitionBy(key, "__span").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy(key, "__span").agg(combine("__value").alias("__sum")).select(key, "__span", combine("__sum").over(before).alias("__before"))
    both = F.array_compact(F.array(combine("__value").over(inside), "__before"))
    joined = cut.join(spans, [key, "__span"]).withColumn("__both", both)
    total = F.aggregate("__both", F.lit(None).cast("long"), lambda a, x: F.coalesce(a + x, x) if combine is F.sum else F.greatest(a, x))
    return joined.withColumn(name, total).drop("__span", "__value", "__before", "__both")


def _merges(folds: DataFrame) -> DataFrame:
    """(centre, at, v, takes) of each fold that joins two components, written.

    At ``at`` the component of v joins that of centre; where ``takes``, the record that v
    stands for then has all. Every round, each vertex joins along the earliest of its
    folds: at that moment its component is what it stands for, and from then on its other
    folds, which are later, are folds of the one it has joined. So folds are the edges of
    a forest of least moments, found for all vertices at once.
    """
    edges = written(folds.where("owner <> gone").select("at", F.col("owner").alias("a"), F.col("gone").alias("b")), "folds")
    merges = None
    while True:
        ends = edges.select(F.col("a").alias("v"), "at", F.col("b").alias("w"), F.lit(True).alias("owner")).unionByName(
            edges.select(F.col("b").alias("v"), "at", F.col("a").alias("w"), F.lit(False).alias("owner")))
        first = written(ends.groupBy("v").agg(F.min(F.struct("at", "w", "owner")).alias("e")).select("v", "e.*"), "folds-first")
        paired = first.join(first.select(F.col("v").alias("w"), F.col("at").alias("w_at")), "w")
        joins = written(paired.withColumn("centre", F.col("owner") & (F.col("at") == F.col("w_at"))), "folds-joins")
        centres = follow(joins.select(F.col("v").alias("node"), F.when(F.col("centre"), F.col("v")).otherwise(F.col("w")).alias("to")))
        new = joins.where("not centre").join(centres, F.col("v") == F.col("node")).select(F.col("root").alias("centre"), "at", "v", F.col("owner").alias("takes"))
        if merges is not None:  # what was to join v after v itself had joined another joins that one
            joined = new.select(F.col("v").alias("centre"), F.col("at").alias("since"), F.col("centre").alias("to"))
            now = F.when(F.col("since") < F.col("at"), F.col("to")).otherwise(F.col("centre"))
            new = new.unionByName(merges.join(joined, "centre", "left").select(now.alias("centre"), "at", "v", "takes"))
        grown = written(new, "folds-merges")
        left = edges.join(centres.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(centres.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        rest = written(left.where("x <> y").select("at", F.col("x").alias("a"), F.col("y").alias("b")), "folds")
        drop(edges, first, joins, centres, *([] if merges is None else [merges]))
        merges, edges = grown, rest
        if edges.isEmpty():
            drop(edges)
            return merges


def _tree(folds: DataFrame) -> DataFrame:
    """(gone, owner, at), written: which record went into which, both as they stood at that moment."""
    merges = _merges(folds)
    takes = merges.where("takes").select(F.col("centre").alias("x"), "at", F.lit(True).alias("taken"), F.lit(None).cast("boolean").alias("of_v"))
    asked = lambda c, of_v: merges.select(F.col(c).alias("x"), "at", F.lit(False).alias("taken"), F.lit(of_v).alias("of_v"))
    rows = takes.unionByName(asked("v", True)).unionByName(asked("centre", False))
    told = running(rows, "x", "at", F.when(F.col("taken"), F.col("at")), F.max, "last", ties=("taken",)).where("not taken")
    told = written(told.groupBy("at").agg(F.max(F.when(F.col("of_v"), F.col("last"))).alias("of_v"), F.max(F.when(~F.col("of_v"), F.col("last"))).alias("of_centre")), "folds-told")
    ends = follow(told.select(F.col("at").alias("node"), F.coalesce("of_v", "at").alias("to")))
    stood = ends.join(merges.select(F.col("at").alias("root"), F.col("v").alias("record")), "root").select("node", "record")
    j = merges.join(told, "at").join(stood.select(F.col("node").alias("at"), F.col("record").alias("v_record")), "at")
    j = j.join(stood.select(F.col("node").alias("of_centre"), F.col("record").alias("c_record")), "of_centre", "left").withColumn("c_record", F.coalesce("c_record", "centre"))
    pick = lambda a, b: F.when(F.col("takes"), F.col(a)).otherwise(F.col(b))
    out = written(j.select(pick("c_record", "v_record").alias("gone"), pick("v_record", "c_record").alias("owner"), "at"), "folds-tree")
    drop(merges, told, ends)
    return out


def fold_order(folds: DataFrame) -> DataFrame:
    """(gone, owner, nth) of ``folds`` (at long, owner, gone), written: who has each record in the end, and at which place.

    Folds are done in order of ``at`` (distinct). Each folds the record that has ``gone``
    by then, with all that it has folded in, into the one that has ``owner``; where that
    is one record, nothing happens. Places are counted from 0.
    """
    tree = _tree(folds)
    up = tree.join(tree.select(F.col("gone").alias("owner"), F.col("gone").alias("up")), "owner", "left")
    sizes = written(up.select("gone", "owner", "at", "up", F.col("up").alias("jump"), F.lit(1).cast("long").alias("size")), "folds-sizes")
    while not sizes.where("jump is not null").isEmpty():  # the size of what went with each record, by doubling
        more = sizes.where("jump is not null").groupBy(F.col("jump").alias("gone")).agg(F.sum("size").alias("more"))
        ahead = sizes.select(F.col("gone").alias("jump"), F.col("jump").alias("next"))
        grown = sizes.join(more, "gone", "left").join(ahead, "jump", "left").select("gone", "owner", "at", "up", F.col("next").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        grown = written(grown, "folds-sizes")
        drop(sizes)
        sizes = grown
    placed = running(sizes, "owner", "at", F.col("size"), F.sum, "upto").withColumn("place", F.col("upto") - F.col("size") + 1)
    now = written(placed.select("gone", "owner", F.col("up").alias("jump"), "place"), "folds-places")
    drop(tree, sizes)
    while not now.where("jump is not null").isEmpty():  # places add up towards the record that stays
        ahead = now.select(F.col("gone").alias("jump"), F.col("owner").alias("top"), F.col("jump").alias("next"), F.col("place").alias("more"))
        there = now.join(ahead, "jump", "left").select(
            "gone", F.coalesce("top", "owner").alias("owner"), F.col("next").alias("jump"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        there = written(there, "folds-places")
        drop(now)
        now = there
    out = now.select("gone", "owner", (F.col("place") - 1).cast("int").alias("nth"))
    out.written_at = now.written_at
    return out
