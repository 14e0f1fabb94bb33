"""Links inside blocks of rows, and connected groups of links, without listing all pairs of a block."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import table

#: Rows of a block from which it gets more centres before its rows are compared with each other.
CROWD = 16


def _apart(links: DataFrame) -> int:
    """Nodes that keep distinct links (u, v) from being stars around their smallest ids: with two parents, or parent and child."""
    roles = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("child")),
                                           F.struct(F.col("v").alias("id"), F.lit(0).alias("child")))).alias("r"))
    per = roles.groupBy("r.id").agg(F.sum("r.child").alias("parents"), F.min("r.child").alias("least"))
    return per.where("parents > 1 or (parents = 1 and least = 0)").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every node of the edges (a, b).

    Alternates two star steps until only stars are left: each node hands its greater neighbours, then its smaller ones, to
    the smallest of its neighbourhood.  Minima are aggregated before the shuffle and joined back, so a node with very many
    links is never gathered.  Only one count per round reaches the driver.
    """
    links = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while _apart(links):
        least = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), "v")) \
                     .groupBy("u").agg(F.min("v").alias("m"))
        large = table(links.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = table(large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                      .where("u <> v").distinct())
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")) \
                .unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def block_groups(members: DataFrame, near: Callable[[Column, Column], Column], verify: Callable[..., DataFrame],
                 measure: Callable[[DataFrame], DataFrame] | None = None,
                 may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
                 marks: Callable[[DataFrame], DataFrame] | None = None,
                 fits: Callable[[Column, Column], Column] | None = None, rounds: int = 0,
                 band: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, component of all rows that verified links inside blocks connect.

    ``members``: key, id, sketch (long).  ``near`` compares two sketches, in any order, cheaply; ``verify`` keeps the true links
    of pairs (a, b).

    0. Blocks of two rows, nearly all of those that meet by chance, are one pair each, read from the aggregate that counts.
    1. In each larger block every row is compared with one centre, the row that shares blocks with most others.
    2. These links make groups.  Rows of a block outside its centre's group, usually few, are compared with all rows of
       the block that are in another group; that finds what the centre did not see.
    Pairs inside one group need no look: they can add nothing to the groups.

    ``measure`` adds to pairs (id, c) of a row and its centre columns that say how the two differ, and leaves out rows that
    can link with nothing; ``may_link`` tells from those of two rows of one centre whether they can be linked.  Then step 2
    compares the rows of a centre, all its blocks as one, and only pairs that can be linked are made.

    ``marks`` gives a table id, mark and more of the ids that share a block, without those that can link with nothing;
    ``fits`` tells from the marks of two rows whether they can be linked, and only such pairs are made.  ``verify`` gets the
    table, too.  ``rounds`` are repeats of step 1 with another row as centre in blocks of more than ``CROWD`` rows that are
    not one group yet, so that few rows are left for step 2, which compares the rows of a centre as above.  ``band`` tells a
    whole number from a mark; rows whose numbers differ by more than one cannot be linked and do not meet in step 2.
    """
    ends = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("id").alias("a"), F.max("id").alias("b"),
                                      F.min("sketch").alias("_sa"), F.max("sketch").alias("_sb"))
    sizes = table(ends.where((F.col("_n") > 2) | (F.col("_n") == 2) & near(F.col("_sa"), F.col("_sb")))
                  .select("key", "_n", "a", "b"))
    # of few keys, written by themselves, so that they are sent to the members where they are small
    larger = table(sizes.where("_n > 2").select("key", "_n"))
    shared = table(members.join(larger, "key"))
    twos = sizes.where("_n = 2 and a <> b").select("a", "b")
    mark, known = [], ()
    if marks is not None:
        twos = twos.distinct()
        marked = marks(shared.select("id").unionByName(twos.select(F.explode(F.array("a", "b")).alias("id"))).distinct())
        mark, known, own = ["mark"], (marked,), marked.select("id", "mark")
        shared = table(shared.join(own, "id"))
        twos = twos.join(own.withColumnsRenamed({"id": "a", "mark": "x"}), "a") \
                   .join(own.withColumnsRenamed({"id": "b", "mark": "y"}), "b").where(fits(F.col("x"), F.col("y"))).select("a", "b")

    def alike(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
        close = near(x("sketch"), y("sketch"))
        return close & fits(x("mark"), y("mark")) if mark else close

    def with_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
        """Pairs of rows and their block's centre that can be linked."""
        found = rows.alias("x").join(centres.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id"))
                                     & alike(lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}")))
        return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    weight = shared.groupBy("id").agg(F.sum("_n").alias("_w"))
    centres = table(shared.join(weight, "id").groupBy("key").agg(
        F.min_by(F.struct("id", "sketch", *mark), F.struct(-F.col("_w"), F.col("id"))).alias("_c")).select("key", "_c.*"))
    pairs = table(with_centre(shared, centres).unionByName(twos).distinct())
    groups = components(verify(pairs, *known))

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(groups, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")

    def joined_groups(new: DataFrame) -> DataFrame:
        return components(verify(new, *known).unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    for turn in range(rounds):
        crowds = table(grouped(shared.where(F.col("_n") > CROWD)))
        apart = crowds.groupBy("key").agg(
            F.min("group").alias("_least"), F.max("group").alias("_most"),
            F.min_by(F.struct("id", "sketch", "group", *mark), F.xxhash64(F.lit(turn), "id")).alias("_c")) \
            .where("_least <> _most").select("key", "_c.*").withColumnRenamed("group", "_g")
        left = crowds.join(apart.select("key", "_g"), "key").where(F.col("group") != F.col("_g"))
        new = table(with_centre(left, apart).distinct().join(pairs, ["a", "b"], "left_anti"))
        pairs = pairs.unionByName(new)
        groups = joined_groups(new)
    centre_group = grouped(centres.select("key", "id")).select("key", F.col("id").alias("c"), F.col("group").alias("_g"))
    tagged = table(grouped(shared.drop("_n")).join(centre_group, "key"))
    outside = F.col("group") != F.col("_g")
    others = tagged.join(tagged.where(outside).select("key").distinct(), "key", "left_semi")
    by = ["key"]
    if measure is not None or mark:
        others, by = table(others.select("id", "c", "sketch", "group", "_g", *mark).distinct()), ["c"]
    differ = (F.col("x.group") != F.col("y.group")) & alike(lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}"))
    if measure is not None:
        others = table(others.join(measure(others.select("id", "c")), ["id", "c"]))
        differ &= may_link(lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}"))
    # two rows that are both outside are one pair, not two
    once = (F.col("x.group") == F.col("x._g")) | (F.col("x.id") < F.col("y.id"))
    beside = others.where(outside)
    if band is not None:
        others, by = others.withColumn("_band", band(F.col("mark"))), [*by, "_band"]
        beside = beside.withColumn("_band", F.explode(F.array(*[band(F.col("mark")) + k for k in (-1, 0, 1)])))
    same = reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in by])
    more = table(others.alias("x").join(beside.alias("y"), same & once & differ)
                 .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
                 .join(pairs, ["a", "b"], "left_anti"))
    if not more.agg(F.count("*")).first()[0]:
        return groups
    return joined_groups(more)
