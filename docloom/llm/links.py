"""From candidate groups to classes of linked items, with DataFrame functions.

A group holds items that may be linked to each other, and `near`, a cheap test
of two items' sketches, tells which pairs cannot be. What is near is verified:

  1. stars: each group's pivot is compared with the rest, twice, by another
     pivot each time; this settles groups of copies, however large;
  2. what is left: pairs of a group that still lie in different components,
     block by block, so that no task holds a large group.

Two items of a group that end in different components were compared in the
second step, or ruled out by near, so no link between classes is lost; links
inside a component are not spelled out. Tables of each step are written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import written

BLOCK = 512


def contracted(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): item, component (its least item).
    Each round hooks every component to its least neighbour and follows the
    hooks a few steps; the graph shrinks until no edge is left."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hooks = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("item"), F.least("a", "b").alias("component"))
        hook = written(_followed(least, least), "hooks")
        hook = written(_followed(hook, hook), "hooks") if hooks else hook
        hooks.append(hook)
        x, y = hook.select(F.col("item").alias("a"), F.col("component").alias("x")), hook.select(F.col("item").alias("b"), F.col("component").alias("y"))
        e = e.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = written(e, "edges")
    out = hooks[0] if hooks else e.select(F.col("a").alias("item"), F.col("b").alias("component"))
    for hook in hooks[1:]:  # every item is in the first; later ones are of components that are left
        out = _followed(out, hook)
    return written(out, "components") if len(hooks) > 1 else out


def _followed(parts: DataFrame, hook: DataFrame) -> DataFrame:
    """parts with each component replaced by what it hooks on to."""
    up = hook.select(F.col("item").alias("component"), F.col("component").alias("up"))
    return parts.join(up, "component", "left").select("item", F.coalesce("up", "component").alias("component"))


def star_pairs(groups: DataFrame, near: Callable[[Column, Column], Column], turn: int) -> DataFrame:
    """Pairs (a, b), a < b, of each group's pivot with those near it. A pivot is
    the item with the least hash, so that one item is the pivot of many groups."""
    row = F.struct(*groups.columns)
    pivots = groups.groupBy("g").agg(F.min(F.struct(F.xxhash64("item", F.lit(turn)).alias("h"), row.alias("x"))).alias("p")).select("g", F.col("p.x").alias("x"))
    met = groups.select("g", row.alias("y")).join(pivots, "g").where((F.col("x.item") != F.col("y.item")) & near(F.col("x"), F.col("y")))
    return met.select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")).distinct()


def apart_pairs(groups: DataFrame, near: Callable[[Column, Column], Column], block: int = BLOCK) -> DataFrame:
    """Each pair (a, b), a < b, of items that share a group, differ in
    component and are near. Groups of more than about `block` items are cut
    into blocks, and each two blocks meet under a key of their own."""
    sizes = groups.groupBy("g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = groups.join(sizes, "g").withColumn("own_block", F.pmod(F.xxhash64("item", F.lit(2)), F.col("blocks")))
    own, last = F.col("own_block"), F.col("blocks") - 1
    side = lambda to, other: dealt.select("g", F.struct(*groups.columns, "own_block").alias(to), F.explode(other).alias("other"))
    left = side("x", F.sequence(own, last)).select("g", F.col("x.own_block").alias("i"), F.col("other").alias("j"), "x")
    right = side("y", F.sequence(F.lit(0).cast("long"), own)).select("g", F.col("other").alias("i"), F.col("y.own_block").alias("j"), "y")
    once = (F.col("i") < F.col("j")) | (F.col("x.item") < F.col("y.item"))
    met = left.join(right, ["g", "i", "j"]).where(once & (F.col("x.component") != F.col("y.component")) & near(F.col("x"), F.col("y")))
    return met.select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")).distinct()


def linked(groups: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable[[Column, Column], Column], stars: int = 2, apart: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """groups, a stored table, has g and item, each pair of them once, and what
    near looks at: it takes two rows of groups as structs. verify takes pairs
    (a, b), a < b, and returns those that are linked. apart replaces the second
    step: it takes groups with components and gives pairs worth verifying.
    Returns the components of linked items (item, component) and the links
    found (a, b)."""
    apart = apart or (lambda rows: apart_pairs(rows, near))
    links, parts, open_ = None, None, groups.withColumn("component", F.col("item"))
    for turn in range(stars + 1):
        last = turn == stars
        pairs = apart(open_) if last else star_pairs(open_, _apart(near), turn)
        new = written(verify(written(pairs, "pairs")), "links")
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        parts = contracted(links)
        if not last:
            open_ = _open(groups, parts)
    return parts, links


def _apart(near: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: (x["component"] != y["component"]) & near(x, y)


def _open(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the groups that lie in several components, with these."""
    at = groups.join(parts, "item", "left").withColumn("component", F.coalesce("component", "item"))
    several = at.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("g")
    return written(at.join(several, "g"), "open")
