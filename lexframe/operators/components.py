"""Strong components of the module graph, and how much each module reaches, without a row per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.sources.workdir import checkpoint


def _label(path: Column, component: Column) -> Column:
    return F.coalesce(component, path)


def _trim(edges: DataFrame) -> DataFrame:
    """Edges between modules that have both a way in and a way out; others lie on no cycle."""
    into, out_of = edges.select(F.col("dst").alias("src")), edges.select(F.col("src").alias("dst"))
    return edges.join(into, "src", "left_semi").join(out_of, "dst", "left_semi")


def _chains(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Where modules with one way out lead to: ``(jumps, ends)``, doubling the distance each round.

    ``jumps[k]`` has ``path, at``: the module ``2 ** k`` steps on, or the first with another number of ways out if that comes before. ``ends`` has
    ``path, at, low, ends``: ``at`` the end of the chain; those that never end lead into a ring without a way out, ``at`` is a module of the ring then and
    ``low`` the smallest of it if ``path`` is on it.
    """
    single = edges.groupBy(F.col("src").alias("path")).agg(F.max("dst").alias("at"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    goes_on = single.select(F.col("path").alias("at"), F.lit(True).alias("goes_on"))
    state = checkpoint(
        single.join(goes_on, "at", "left")
        .select("path", "at", F.col("path").alias("low"), F.col("goes_on").isNull().alias("ends"), F.lit(True).alias("new")))
    jumps, before = [state.select("path", "at")], None
    while True:
        onward = state.select(F.col("path").alias("at"), F.col("at").alias("far"), F.col("low").alias("far_low"), F.col("ends").alias("far_ends"))
        lower = F.col("far_low") < F.col("low")
        state = checkpoint(state.join(onward, "at", "left").select(
            "path", F.coalesce("far", "at").alias("at"), F.when(lower, F.col("far_low")).otherwise(F.col("low")).alias("low"),
            F.coalesce("far_ends", "ends").alias("ends"), F.coalesce(lower, F.lit(False)).alias("new")))
        # on a ring the smallest is known to all once a round changes none; tails are passed once the modules led to are no fewer than before
        open_ = state.filter("not ends")
        now = open_.agg(F.count(F.lit(1)), F.count_distinct("at"), F.coalesce(F.max("new"), F.lit(False))).first()
        if now[0] == 0 or (before is not None and now[:2] == before[:2] and not now[2]):
            return jumps, state.drop("new")
        jumps.append(state.select("path", "at"))
        before = now


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
    """Folds every chain of modules with one way out into its end; ``(edges left, path and component of rings, what _unfold needs)``."""
    jumps, ends = _chains(edges)
    on_ring = ends.filter("not ends").select(F.col("at").alias("path")).distinct()
    rings = checkpoint(ends.join(on_ring, "path", "left_semi").select("path", F.col("low").alias("component")))
    entries = checkpoint(
        edges.join(ends.select(F.col("path").alias("src")), "src", "left_anti")
        .join(ends.select(F.col("path").alias("dst"), "at", "ends"), "dst", "left")
    )
    kept = entries.filter("ends is null or ends").select("src", F.coalesce("at", "dst").alias("dst")).filter("src <> dst")
    return checkpoint(kept.distinct()), rings, (jumps, entries.filter("ends").select("src", F.col("dst").alias("path"), "at"))


def _unfold(found: DataFrame, fold: tuple) -> DataFrame:
    """``path, component`` of the folded modules that share the component of their chain's end.

    They do from where a module of that component leads into the chain; the jumps, longest first, mark all that come after.
    """
    jumps, entries = fold
    label = lambda end: found.select(F.col("path").alias(end), F.col("component").alias(f"{end}_component"))
    joint = _label(F.col("at"), F.col("at_component"))
    marked = checkpoint(
        entries.join(label("at"), "at", "left").join(label("src"), "src", "left")
        .filter(joint == _label(F.col("src"), F.col("src_component"))).select("path", joint.alias("component")).distinct()
    )
    for jump in reversed(jumps):
        if marked.isEmpty():
            break
        onward = marked.join(jump, "path").select(F.col("at").alias("path"), "component")
        marked = checkpoint(marked.unionByName(onward).distinct())
    return marked.join(jumps[0].select("path"), "path", "left_semi")


def _colours(edges: DataFrame) -> DataFrame:
    """``path, colour``: the smallest module that leads to each, itself included. A round passes on what the round before changed."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    colours = checkpoint(nodes.select("path", F.col("path").alias("colour"), F.lit(True).alias("new")))
    while not colours.filter("new").isEmpty():
        offers = (
            colours.filter("new").select(F.col("path").alias("src"), "colour").join(edges, "src")
            .groupBy(F.col("dst").alias("path")).agg(F.min("colour").alias("offer"))
        )
        better = F.coalesce(F.col("offer") < F.col("colour"), F.lit(False))
        colours = checkpoint(colours.join(offers, "path", "left").select(
            "path", F.when(better, F.col("offer")).otherwise(F.col("colour")).alias("colour"), better.alias("new")))
    return colours.drop("new")


def _coloured_components(edges: DataFrame) -> DataFrame:
    """``path, component`` of modules that lead back, within their colour, to the module that gave it; and so on with the rest."""
    found = None
    while not edges.isEmpty():
        colours = _colours(edges)
        of = lambda end: colours.select(F.col("path").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = checkpoint(
            edges.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour")
            .select("src", "dst", F.col("src_colour").alias("colour"))
        )
        reached = frontier = colours.filter("path = colour")
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("path").alias("dst")), "dst").select(F.col("src").alias("path"), "colour").distinct()
            frontier = checkpoint(back.join(reached, "path", "left_anti"))
            reached = reached.unionByName(frontier)
        reached = checkpoint(reached.select("path", F.col("colour").alias("component")))
        found = reached if found is None else found.unionByName(reached)
        done = reached.select("path")
        rest = inner.join(done.withColumnRenamed("path", "src"), "src", "left_anti").join(done.withColumnRenamed("path", "dst"), "dst", "left_anti")
        edges = checkpoint(_trim(rest.select("src", "dst")))
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """``path, component, size, cyclic``: modules that reach each other; the component is its smallest path.

    ``edges`` have ``path`` and ``target_path``; a null at either end is no edge. Modules on no cycle are cut off and chains of modules with one way
    out fold into their end by pointers that double their reach each round; rings are found on the way. What is left is coloured by the
    smallest module that leads to it; those of a colour that lead back to it are its component. There is never a row per pair.
    """
    named = edges.select(F.col("path").alias("src"), F.col("target_path").alias("dst")).filter("src is not null and dst is not null")
    links = checkpoint(named.distinct())
    nodes = links.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    work, folds = checkpoint(_trim(links.filter("src <> dst"))), []
    found = nodes.select("path", F.col("path").alias("component")).limit(0)
    before = links.count()
    while (n := work.count()) > 0:
        if work.groupBy("src").count().filter("count = 1").isEmpty():
            if n == before:
                break
        else:
            work, rings, fold = _contract(work)
            folds.append(fold)
            found = found.unionByName(rings)
        before = n
        work = checkpoint(_trim(work))
    if n:
        found = found.unionByName(_coloured_components(work))
    for fold in reversed(folds):
        found = checkpoint(found.unionByName(_unfold(found, fold)))
    labelled = nodes.join(found, "path", "left").withColumn("component", _label(F.col("path"), F.col("component")))
    groups = labelled.groupBy("component").agg(F.min("path").alias("smallest"), F.count(F.lit(1)).alias("size"))
    loops = links.filter("src = dst").select(F.col("src").alias("path"), F.lit(True).alias("loop"))
    return labelled.join(groups, "component").join(loops, "path", "left").select(
        "path", F.col("smallest").alias("component"), "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def reach_sizes(edges: DataFrame, components: DataFrame, *, lg_k: int = 14) -> DataFrame:
    """``path, n_reached``: about how many modules each module reaches, itself only if it is on a cycle.

    Distinct-count sketches of fixed size go along the edges between components, against their direction, until none changes; a round sends
    those that changed. Counts up to ``2 ** lg_k / 32`` are exact but for hash collisions, larger ones have a relative standard error of
    ``1.04 / sqrt(2 ** lg_k)``.
    """
    components = checkpoint(components)
    of = lambda end, name: components.select(F.col("path").alias(end), F.col("component").alias(name))
    between = checkpoint(
        edges.join(of("path", "src"), "path").join(of("target_path", "dst"), "target_path")
        .filter("src <> dst").select("src", "dst").distinct()
    )
    own = components.groupBy("component").agg(F.hll_sketch_agg("path", lg_k).alias("sketch"))
    state = checkpoint(own.withColumn("new", F.lit(True)))
    while not state.filter("new").isEmpty():
        sent = (
            state.filter("new").select(F.col("component").alias("dst"), "sketch").join(between, "dst")
            .groupBy(F.col("src").alias("component")).agg(F.hll_union_agg("sketch").alias("offer"))
        )
        joint = F.when(F.col("offer").isNull(), F.col("sketch")).otherwise(F.hll_union("sketch", "offer"))
        grown = F.hll_sketch_estimate("joint") > F.hll_sketch_estimate("sketch")
        state = checkpoint(
            state.join(sent, "component", "left").withColumn("joint", joint)
            .select("component", F.col("joint").alias("sketch"), grown.alias("new")))
    sizes = state.select("component", F.hll_sketch_estimate("sketch").alias("n"))
    return components.join(sizes, "component").select("path", (F.col("n") - F.when(F.col("cyclic"), 0).otherwise(1)).cast("long").alias("n_reached"))
