"""Edges between modules: imports matched with exports, and what a module reaches through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions.paths import normalize
from lexframe.sources.workdir import checkpoint


def resolve_path(path: Column, source: Column) -> Column:
    """Path a relative module source names, seen from ``path``; null for other sources."""
    folder = F.regexp_extract(path, r"^(.*/)?", 0)
    return F.when(source.rlike(r"^\.\.?/"), normalize(F.concat(folder, source)))


def star_closure(stars: DataFrame) -> DataFrame:
    """``target_id, star_id``: modules whose names a module passes on by ``export *``, over any number of hops.

    A round extends only the pairs the round before found; the last finds none. Cycles stop by themselves.
    """
    step = checkpoint(stars.select("target_id", "star_id").distinct())
    reached = frontier = step
    while not frontier.isEmpty():
        onward = frontier.withColumnRenamed("star_id", "mid").join(
            step.select(F.col("target_id").alias("mid"), "star_id"), "mid"
        )
        frontier = checkpoint(onward.select("target_id", "star_id").distinct().join(reached, ["target_id", "star_id"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def module_edges(imports: DataFrame, exports: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each import row with the script it resolves to.

    ``status``: ``external`` (not a relative source), ``missing`` (no such script), ``module`` (needs no
    name), ``resolved``, ``resolved_star`` (through ``export *`` of the target, over any number of hops; of several the smallest
    script) or ``unresolved``. Exports are unique per path and name before the join, so an import matches at most one. External
    and missing imports, most rows of real code, take no part in the joins by name.
    """
    paths = scripts.select("script_id", "path")
    wanted = imports.join(paths, "script_id").withColumn("target_path", resolve_path(F.col("path"), F.col("source")))
    targets = paths.groupBy(F.col("path").alias("target_path")).agg(F.max("script_id").alias("target_id"))
    named = (
        exports.filter(F.col("exported").isNotNull()).groupBy("script_id", "exported").agg(F.min("pos").alias("export_pos"))
    )
    stars = exports.filter(F.col("is_all") & F.col("alias").isNull()).join(paths, "script_id").select(
        F.col("script_id").alias("target_id"), resolve_path(F.col("path"), F.col("source")).alias("star_path")
    ).filter("star_path is not null").distinct()
    star_targets = stars.join(
        targets.select(F.col("target_path").alias("star_path"), F.col("target_id").alias("star_id")), "star_path"
    )
    external = wanted.filter("target_path is null").withColumns(
        {"target_id": F.lit(None).cast("string"), "export_pos": F.lit(None).cast("int")})
    local = wanted.filter("target_path is not null").join(targets, "target_path", "left")
    missing = local.filter("target_id is null").withColumn("export_pos", F.lit(None).cast("int"))
    direct = named.select(F.col("script_id").alias("target_id"), F.col("exported").alias("imported"), "export_pos")
    found = local.filter("target_id is not null").join(direct, ["target_id", "imported"], "left")
    # names the targets do not export themselves, looked up behind their stars
    open_names = found.filter(
        F.col("imported").isNotNull() & F.col("export_pos").isNull() & (F.col("imported") != "default")
    ).select("target_id", "imported").distinct()
    behind = (
        open_names.join(star_closure(star_targets), "target_id")
        .join(named.select(F.col("script_id").alias("star_id"), F.col("exported").alias("imported")), ["star_id", "imported"])
        .groupBy("target_id", "imported").agg(F.min("star_id").alias("star_id"))
    )
    none = F.lit(None).cast("string")
    found = found.join(behind, ["target_id", "imported"], "left").unionByName(
        missing.unionByName(external).withColumn("star_id", none))
    status = (
        F.when(F.col("target_path").isNull(), "external")
        .when(F.col("target_id").isNull(), "missing")
        .when(F.col("imported").isNull(), "module")
        .when(F.col("export_pos").isNotNull(), "resolved")
        .when(F.col("star_id").isNotNull(), "resolved_star")
        .otherwise("unresolved")
    )
    return found.select(
        "script_id", "pos", "path", "local", "imported", "source", "target_path",
        F.coalesce("star_id", "target_id").alias("target_script"), status.alias("status"),
    )


def module_reach(edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Shortest distance between modules that reach each other: ``src, dst, depth``.

    With ``entries`` (``path`` of the modules to start from) only pairs that start there, which is what a large graph needs: all
    pairs grow with its square. Rounds of joins only extend pairs found in the round before; each round is written out, so the
    lineage stays short, and they end when a round finds nothing new. A cycle stops by itself.
    """
    step = checkpoint(edges.select(F.col("path").alias("src"), F.col("target_path").alias("dst")).distinct())
    start = step if entries is None else step.join(entries.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    reached = frontier = start.withColumn("depth", F.lit(1))
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        onward = frontier.select("src", F.col("dst").alias("mid")).join(
            step.select(F.col("src").alias("mid"), "dst"), "mid"
        )
        frontier = checkpoint(
            onward.select("src", "dst").distinct().join(reached.select("src", "dst"), ["src", "dst"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        reached = reached.unionByName(frontier)
    return reached


def reach_counts(reached: DataFrame) -> DataFrame:
    """How many modules each module reaches, and how far the farthest is."""
    return reached.groupBy("src").agg(F.count(F.lit(1)).alias("n_reached"), F.max("depth").alias("farthest"))
