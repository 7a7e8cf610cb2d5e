"""The graph of chunks: entity edges, kept as their incidence table of (key, entity) rows,
and the weaker theme edges.

Entity edges follow by a join, for the nodes a query asks about; theme edges are at most ten
a chunk and are made for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import scan
from paperloom.operators.search import bounded_broadcast
from paperloom.session import materialize

# Edge weights.
CROSS_ENTITY, WITHIN_ENTITY, CROSS_THEME, WITHIN_THEME = 1.5, 0.8, 0.6, 0.3
THEME_WINDOW = 5
BLOCK_BITS = 12


def incidence(chunks: DataFrame) -> DataFrame:
    """(key, paper, entity): each chunk's distinct entities of more than two characters,
    upper-cased; an entity repeated in a chunk counts once, so there are no self-loops."""
    e = F.explode("entities")
    return chunks.select(F.col("chunk_key").alias("key"), F.coalesce("paper_title", F.lit("")).alias("paper"), e.alias("raw")).where(F.length("raw") > 2).select("key", "paper", F.upper("raw").alias("entity")).distinct()


def nodes(chunks: DataFrame) -> DataFrame:
    """(key, paper, entities): the incidence as one row a chunk, in 64-bit hashes."""
    names = F.transform(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.length(e) > 2), lambda e: F.xxhash64(F.upper(e)))
    return chunks.select(F.col("chunk_key").alias("key"), F.xxhash64(F.coalesce("paper_title", F.lit(""))).alias("paper"), F.array_distinct(names).alias("entities"))


def gathered(rows: DataFrame) -> DataFrame:
    """The nodes of incidence rows."""
    return rows.groupBy("key").agg(F.xxhash64(F.first("paper")).alias("paper"), F.collect_set(F.xxhash64("entity")).alias("entities"))


def entity_edges(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, weight, n_shared, cross_paper): the edges of the nodes of sources (key)."""
    mine = rows.join(bounded_broadcast(sources.select("key").distinct()), "key", "left_semi").select(F.col("key").alias("src"), F.col("paper").alias("src_paper"), "entity")
    pairs = rows.join(bounded_broadcast(mine), "entity").where("key <> src")
    cross = F.col("paper") != F.col("src_paper")
    return pairs.groupBy("src", F.col("key").alias("dst")).agg(F.round(F.sum(F.when(cross, CROSS_ENTITY).otherwise(WITHIN_ENTITY)), 6).alias("weight"), F.count(F.lit(1)).alias("n_shared"), F.first(cross).alias("cross_paper"))


def linking(rows: DataFrame, *by: str) -> DataFrame:
    """The rows (entity, ...) of entities that link several: rows, or distinct values of the
    columns by. A row an end instead of one a pair, they hold every edge of every node:
    two rows of one entity are its share of their nodes' edge."""
    n = F.countDistinct(*by) if by else F.count(F.lit(1))
    return rows.join(rows.groupBy("entity").agg(n.alias("_n")).where("_n > 1"), "entity", "left_semi")


def positions(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with ``pos``, each row's place in its group by key, from 1: blocks of keys are
    numbered alone and shifted by the sizes of the blocks before, so a group of any size
    spreads over many tasks."""
    blocked = rows.withColumn("_block", F.shiftright(F.col(key), BLOCK_BITS))
    counts = blocked.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = blocked.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_block").orderBy(key)))
    return local.join(before, [group, "_block"]).withColumn("pos", F.col("_before") + F.col("_local")).drop("_block", "_before", "_local")


def theme_places(chunks: DataFrame, *rest: Column | str) -> DataFrame:
    """(theme, key, paper, *rest, pos): each themed chunk's place in its theme by key."""
    themed = chunks.where("trim(theme) <> ''").select(F.col("chunk_key").alias("key"), F.coalesce("paper_title", F.lit("")).alias("paper"), F.lower(F.col("theme")).alias("theme"), *rest)
    return positions(themed, "theme", "key")


def theme_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, weight, cross_paper): chunks of one theme at most five places apart in
    the order of their keys, unless they share an entity. The distance is an equi-join on
    places, so a theme of any size is no group of its own."""
    names = F.transform(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.length(e) > 2), lambda e: F.upper(e))
    placed = theme_places(chunks, names.alias("names"))
    left = placed.select("theme", F.col("key").alias("src"), F.col("paper").alias("p1"), F.col("names").alias("n1"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + THEME_WINDOW)).alias("pos"))
    pairs = left.join(placed.select("theme", F.col("key").alias("dst"), F.col("paper").alias("p2"), F.col("names").alias("n2"), "pos"), ["theme", "pos"])
    cross = F.col("p1") != F.col("p2")
    return pairs.where(~F.arrays_overlap("n1", "n2")).select("src", "dst", F.when(cross, CROSS_THEME).otherwise(WITHIN_THEME).alias("weight"), cross.alias("cross_paper"))


def theme_neighbours(places: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, weight): the theme edges of the nodes of sources (key), either way."""
    mine = places.join(bounded_broadcast(sources.select("key").distinct()), "key", "left_semi")
    steps = F.array(*[F.col("pos") + i for i in range(-THEME_WINDOW, THEME_WINDOW + 1) if i])
    mine = mine.select("theme", F.col("key").alias("src"), F.col("paper").alias("src_paper"), F.explode(steps).alias("pos"))
    cross = F.col("paper") != F.col("src_paper")
    near = places.join(bounded_broadcast(mine), ["theme", "pos"]).select("src", F.col("key").alias("dst"), F.when(cross, CROSS_THEME).otherwise(WITHIN_THEME).alias("weight"))
    near = materialize(near, "theme-steps")
    if "entity" in rows.columns:
        rows = gathered(rows)
    ends = rows.join(bounded_broadcast(near.select(F.explode(F.array("src", "dst")).alias("key")).distinct()), "key", "left_semi")
    ends = materialize(ends.where("size(entities) > 0"), "theme-ends")
    side = lambda c: ends.select(F.col("key").alias(c), F.col("entities").alias(f"{c}_entities"))
    both = near.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    return both.where(~F.coalesce(F.arrays_overlap("src_entities", "dst_entities"), F.lit(False))).select("src", "dst", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    """Theme edges with each end as src."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def all_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, weight, n_shared, cross_paper): the whole graph, entity and theme edges,
    each from both its ends; theme edges share no entity."""
    entity = entity_edges(incidence(chunks), chunks.select(F.col("chunk_key").alias("key")))
    return entity.unionByName(both_ways(theme_edges(chunks)).withColumn("n_shared", F.lit(0).cast("long")))


def agreements(edges: DataFrame, directions: DataFrame) -> DataFrame:
    """(src, dst, relation): cross-paper edges whose ends' directions (key, direction) agree
    ('consensus', both up or both down) or conflict ('contradiction', one up, one down)."""
    side = lambda s: directions.where("direction <> 'neutral'").select(F.col("key").alias(s), F.col("direction").alias(f"{s}_direction"))
    rows = edges.where("cross_paper AND n_shared > 0").join(side("src"), "src").join(side("dst"), "dst")
    return rows.select("src", "dst", F.when(F.col("src_direction") == F.col("dst_direction"), "consensus").otherwise("contradiction").alias("relation"))


def walk(rows: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 4, themes: DataFrame | None = None) -> DataFrame:
    """(query, key, hop): nodes reached from seeds (query, key) over the entity edges of the
    incidence rows (or of nodes) and the theme edges of themes (theme_places). Each hop
    takes the first ``most`` rows of the frontier's edges to unvisited nodes by weight and
    key, repeats among them count once, and the walk ends at ``most`` nodes.

    A node's edges beyond its first ``most`` plus the number of a query's visited nodes
    can't be among the first of any query, so no more of them are made."""
    rows = materialize(gathered(rows) if "entity" in rows.columns else rows, "nodes")  # read by every hop
    themes = None if themes is None else materialize(themes, "themes")
    visited = materialize(seeds.select("query", "key").distinct(), "walk")
    frontier, reached = visited, None
    for hop in range(1, depth + 1):
        many = visited.groupBy("query").count().agg(F.max("count")).first()[0] or 0
        edges = scan.neighbours(rows, frontier, most + many, CROSS_ENTITY, WITHIN_ENTITY)
        if themes is not None:
            edges = edges.unionByName(theme_neighbours(themes, rows, frontier))
        steps = frontier.join(edges, frontier.key == edges.src).select("query", F.col("dst").alias("key"), "weight").join(visited, ["query", "key"], "left_anti")
        ranked = steps.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), F.desc("key")))).where(F.col("r") <= most)
        new = materialize(ranked.groupBy("query", "key").agg(F.min("r").alias("r")).withColumn("hop", F.lit(hop)), "walk")
        reached = new if reached is None else reached.unionByName(new)
        visited, frontier = visited.unionByName(new.select("query", "key")), new.select("query", "key")
    total = reached.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("hop", "r")))
    return total.where(F.col("n") <= most).select("query", "key", "hop")
