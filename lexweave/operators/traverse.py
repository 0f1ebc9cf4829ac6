"""Traversal: bounded breadth-first search, paths, subtrees, chains and closures; plans, no driver loops over data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.numbers import ancestors_and_self, article_id, law_of, number_key, number_of
from lexweave.sources.scratch import written


def with_ancestors(ids: DataFrame) -> DataFrame:
    """``(via, article_id)``: each id with itself and every provision that contains it, from the ids alone."""
    return ids.select(F.col("article_id").alias("via"), F.explode(_up("article_id")).alias("article_id"))


def _up(id_: str) -> Column:
    """An id and those of every provision that contains it."""
    return F.transform(ancestors_and_self(number_of(id_)), lambda n: article_id(law_of(id_), n))


def indirect_refs(refs: DataFrame, frontier: DataFrame, seeds: DataFrame, max_depth: int, climb: bool = True) -> DataFrame:
    """All references ``(refs.*, via_article_id, depth)`` that reach a provision at its smallest depth.

    ``frontier`` is depth 1. At depth d a provision cites one of depth d - 1 or, with ``climb``, a provision that
    contains it. Seeds and provisions already reached are not reached again. Each level joins on the target, so the
    plan has a shuffle per level and no action; depth is at most a handful.
    """
    seen = seeds.select("article_id").union(frontier.select("article_id")).distinct()
    level, out = frontier.select("article_id").distinct(), None
    for depth in range(2, max_depth + 1):
        targets = with_ancestors(level) if climb else level.select(F.col("article_id").alias("via"), "article_id")
        hits = refs.join(targets.withColumnRenamed("article_id", "to_article_id"), "to_article_id")
        hits = hits.join(seen.withColumnRenamed("article_id", "from_article_id"), "from_article_id", "left_anti")
        hits = hits.select(*refs.columns, F.col("via").alias("via_article_id"), F.lit(depth).alias("depth"))
        out = hits if out is None else out.unionByName(hits)
        level = hits.select(F.col("from_article_id").alias("article_id")).distinct()
        seen = seen.union(level)
    return out if out is not None else refs.limit(0).withColumn("via_article_id", F.lit(None).cast("string")).withColumn("depth", F.lit(None).cast("int"))


def labelled_reach(refs: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``(seed, article_id, depth)``: the provisions that cite each of ``seeds(seed)``, or what contains it, directly or over others.

    One search for any number of seeds: every row carries the seed that it belongs to, and what a seed has reached is not
    reached by it again. Depth is the smallest; a seed does not reach itself.
    """
    edges = refs.where("to_article_id IS NOT NULL").select(F.col("from_article_id").alias("article_id"), F.col("to_article_id").alias("target")).distinct()
    level = seeds.select("seed", F.col("seed").alias("article_id")).distinct()
    seen, out = level, None
    for depth in range(1, max_depth + 1):
        up = F.transform(ancestors_and_self(number_of("article_id")), lambda n: article_id(law_of("article_id"), n))
        targets = level.select("seed", F.explode(up).alias("target")).distinct()
        level = edges.join(targets, "target").select("seed", "article_id").distinct().join(seen, ["seed", "article_id"], "left_anti")
        seen = seen.union(level)
        found = level.select("seed", "article_id", F.lit(depth).alias("depth"))
        out = found if out is None else out.unionByName(found)
    return out


def recursive_paths(edges: DataFrame, starts: DataFrame, max_length: int) -> DataFrame:
    """``(path array<string>, length)`` as ``paths`` gives them, by Spark's recursive common table expression.

    The length is a parameter of one plan instead of a join per level; each row carries the edges it has used.
    """
    spark = edges.sparkSession
    return spark.sql(
        """WITH RECURSIVE walk(path, at, used, length) AS (
             SELECT array(id), id, CAST(array() AS ARRAY<STRING>), 0 FROM {starts}
             UNION ALL
             SELECT array_append(path, dst), dst, array_append(used, concat_ws('\u0001', src, dst)), length + 1 FROM walk JOIN {edges} ON at = src
             WHERE length < {most} AND NOT array_contains(used, concat_ws('\u0001', src, dst)))
           SELECT path, length FROM walk WHERE length > 0""",
        starts=starts.select("id"), edges=edges.select("src", "dst"), most=max_length,
    )


def recursive_refs(refs: DataFrame, frontier: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """What ``indirect_refs`` finds, by Spark's recursive common table expression; ``max_depth`` is a parameter of one plan.

    Walks go from a provision to what cites it, or what contains it, and carry what they have visited; the least depth of
    a provision over all walks is its depth. Walks of equal length to one provision are told once each, so this is for
    shallow searches from few seeds: Spark stops at ``spark.sql.cteRecursionRowLimit`` rows with an error. Below that a level
    is sent whole to the references, and the provisions reached are written, so references are read but never dealt anew.
    """
    ends = refs.where("to_article_id IS NOT NULL").join(seeds.select(F.col("article_id").alias("from_article_id")).distinct(), "from_article_id", "left_anti")
    walked = refs.sparkSession.sql(
        r"""WITH RECURSIVE walk(at, depth, seen) AS (
             SELECT article_id, 1, array(article_id) FROM {frontier}
             UNION ALL
             SELECT /*+ BROADCAST(level) */ DISTINCT dst, depth + 1, array_append(seen, dst)
             FROM (SELECT depth, seen, explode(transform(sequence(size(split(number, '[.]')), 1, -1), k -> concat(law, ':', substring_index(number, '.', k)))) AS up
                   FROM (SELECT depth, seen, substring_index(at, ':', 1) AS law, CASE WHEN contains(at, ':') THEN regexp_replace(at, '^[^:]*:', '') ELSE '' END AS number FROM walk WHERE depth < {most}) ids) level
             JOIN {ends} ON up = target WHERE NOT array_contains(seen, dst))
           SELECT at, min(depth) AS depth FROM walk GROUP BY at""",
        frontier=frontier.select("article_id").distinct(), ends=ends.select(F.col("to_article_id").alias("target"), F.col("from_article_id").alias("dst")), most=max_depth,
    )
    walked = written(walked, "walks")
    before = walked.select(F.explode(_up("at")).alias("to_article_id"), F.col("at").alias("via_article_id"), (F.col("depth") + 1).alias("depth"))
    hits = refs.join(before, "to_article_id")
    return hits.join(walked.select(F.col("at").alias("from_article_id"), "depth"), ["from_article_id", "depth"]).select(*refs.columns, "via_article_id", "depth")


def first_witness(found: DataFrame) -> DataFrame:
    """One reference per provision and depth: that with the first target number, then the first via."""
    order = Window.partitionBy("depth", "from_article_id").orderBy(number_key("to_number"), "via_article_id", "to_article_id")
    return found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def paths(edges: DataFrame, starts: DataFrame, max_length: int) -> DataFrame:
    """``(path array<string>, length)`` of all paths from the starts over edges ``(src, dst)``; no edge twice in a path.

    Paths are told once, however often an edge is listed, so edges need not be made distinct first. The starts and each level are
    written: where few paths lead on Spark knows it and sends them to the edges, instead of dealing all edges anew.
    """
    level = written(starts.select(F.array(F.col("id")).alias("path"), F.col("id").alias("at"), F.array().cast("array<string>").alias("used")), "paths")
    out = None
    for length in range(1, max_length + 1):
        step = level.join(edges, level["at"] == edges["src"]).withColumn("edge", F.concat_ws("\u0001", "src", "dst"))
        step = step.where(~F.array_contains("used", F.col("edge")))
        level = written(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), F.concat("used", F.array("edge")).alias("used")).distinct(), "paths")
        found = level.select("path", F.lit(length).alias("length"))
        out = found if out is None else out.unionByName(found)
    return out


def next_chain(rows: DataFrame, law_col: str, order: list[Column]) -> DataFrame:
    """``rows`` with the id of the row that follows in its law, null at the end."""
    return rows.withColumn("next_id", F.lead("article_id").over(Window.partitionBy(law_col).orderBy(*order)))


def parent_edges(articles: DataFrame) -> DataFrame:
    """``(article_id, parent_id)`` of provisions whose parent is there; one whose parent is missing has no edge."""
    parents = articles.select(F.col("article_id").alias("parent_id")).distinct()
    own = articles.where("parent_number IS NOT NULL").select("article_id", article_id("law_id", "parent_number").alias("parent_id"))
    return own.join(parents, "parent_id", "left_semi").select("article_id", "parent_id")


def closure_below(articles: DataFrame, gone: DataFrame) -> DataFrame:
    """Provisions that are among ``gone`` or below one of them: a join with all ancestors instead of a fixpoint."""
    hit = articles.select("article_id", F.explode("ancestor_ids").alias("up")).join(gone.select(F.col("article_id").alias("up")).distinct(), "up", "left_semi")
    return hit.select("article_id").distinct()


def descendants(articles: DataFrame, roots: DataFrame) -> DataFrame:
    """``(root_id, article_id)`` of everything below the roots, the roots themselves not."""
    up = articles.select("article_id", F.explode("ancestor_ids").alias("root_id"))
    return up.join(roots.select(F.col("article_id").alias("root_id")).distinct(), "root_id", "left_semi").where("root_id <> article_id").select("root_id", "article_id")
