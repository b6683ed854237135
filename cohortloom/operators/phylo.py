"""Trees as edge tables, patristic distances and phylogenetic purity.

Sums of tip distances over pairs are sums over edges: an edge of length L with s
of a cluster's n members below it separates s (n - s) pairs. Purity therefore
needs counts per (edge, cluster), never the tip x tip matrix.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalar import pairs_of
from cohortloom.operators.resample import permute_labels
from cohortloom.session import cut

_TOKEN = re.compile(r"'(?:[^']|'')*'|\[[^\]]*\]|[(),:;]|[^\s(),:;\[\]']+")


def parse_newick(text: str) -> list[tuple[int, int | None, float, str | None]]:
    """``(node, parent, branch_length, name)`` rows; quoted names and comments are understood."""
    nodes = [[0, None, 0.0, None]]
    here, length_next = 0, False
    for tok in _TOKEN.findall(text):
        if tok.startswith("["):
            continue
        if tok == "(" or tok == ",":
            parent = here if tok == "(" else nodes[here][1]
            nodes.append([len(nodes), parent, 0.0, None])
            here = len(nodes) - 1
        elif tok == ")":
            here = nodes[here][1]
        elif tok == ":":
            length_next = True
            continue
        elif tok == ";":
            break
        elif length_next:
            nodes[here][2] = float(tok)
        else:
            nodes[here][3] = tok[1:-1].replace("''", "'") if tok.startswith("'") else tok
        length_next = False
    return [tuple(n) for n in nodes]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = [(str(n), None if p is None else str(p), l, name) for n, p, l, name in parse_newick(text)]
    return spark.createDataFrame(rows, "node string, parent string, length double, name string")


def tips(tree: DataFrame) -> DataFrame:
    inner = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    return tree.join(inner, "node", "left_anti")


def inner_nodes(tree: DataFrame) -> DataFrame:
    parents = tree.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
    return tree.join(parents, "node", "left_semi")


def ancestors(tree: DataFrame) -> DataFrame:
    """``(node, anc)`` with every node its own ancestor; path doubling, log2(depth) joins."""
    up = cut(tree.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("anc")))
    all_pairs, n = up, up.count()
    while True:
        above = all_pairs.select(F.col("node").alias("mid"), F.col("anc").alias("top"))
        step = all_pairs.join(above, F.col("anc") == F.col("mid")).select("node", F.col("top").alias("anc"))
        all_pairs = cut(all_pairs.unionByName(step).distinct())
        m = all_pairs.count()
        if m == n:
            break
        n = m
    return all_pairs.unionByName(tree.select("node", F.col("node").alias("anc")))


def root_depth(tree: DataFrame, anc: DataFrame) -> DataFrame:
    edge = tree.select(F.col("node").alias("anc"), "length")
    return anc.join(edge, "anc").groupBy("node").agg(F.sum("length").alias("depth"))


def patristic(tree: DataFrame, anc: DataFrame, pairs: DataFrame) -> DataFrame:
    """``tree_distances`` from a closure ``anc`` that is there already; n x depth rows, so for shallow trees."""
    depth = root_depth(tree, anc)
    key = tree.select("node", F.coalesce("name", "node").alias("id"))
    of = anc.join(key, "node").select("id", "anc")
    d = depth.join(key, "node").select("id", "depth")
    common = (
        pairs.select("a", "b")
        .join(of.select(F.col("id").alias("a"), "anc"), "a")
        .join(of.select(F.col("id").alias("b"), "anc"), ["b", "anc"])
        .join(depth.select(F.col("node").alias("anc"), F.col("depth").alias("dl")), "anc")
        .groupBy("a", "b")
        .agg(F.max("dl").alias("dl"))
    )
    return (
        common.join(d.select(F.col("id").alias("a"), F.col("depth").alias("da")), "a")
        .join(d.select(F.col("id").alias("b"), F.col("depth").alias("db")), "b")
        .select("a", "b", (F.col("da") + F.col("db") - 2 * F.col("dl")).alias("dist"))
    )


def jump_levels(tree: DataFrame) -> list[DataFrame]:
    """Frames ``(node, up, hops, length)``: frame j leads to the 2^j-th ancestor, or to the root if it is nearer.

    One join per level, log2(depth) levels of one row per node; the last one holds every node's root and depth.
    A parent that has no row of its own is a root.
    """
    top = F.col("parent").isNull()
    step = cut(
        tree.select(
            "node",
            F.coalesce("parent", "node").alias("up"),
            F.when(top, 0).otherwise(1).cast("bigint").alias("hops"),
            F.when(top, 0.0).otherwise(F.coalesce("length", F.lit(0.0))).alias("length"),
        )
    )
    levels, n = [step], step.count()
    deepest = step.agg(F.max("hops").alias("h")).first()["h"] or 0
    while True:
        over = step.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("hops").alias("h2"), F.col("length").alias("l2"))
        step = cut(
            step.join(over, "up", "left").select(
                "node",
                F.coalesce("top", "up").alias("up"),
                (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
                (F.col("length") + F.coalesce("l2", F.lit(0.0))).alias("length"),
            )
        )
        now = step.agg(F.max("hops").alias("h")).first()["h"] or 0
        if now > n:
            raise ValueError("the parents of the tree form a cycle")
        if now == deepest:
            return levels
        levels.append(step)
        deepest = now


def tree_distances(tree: DataFrame, pairs: DataFrame, levels: list[DataFrame] | None = None) -> DataFrame:
    """``(a, b, dist)`` of the pairs whose names are known and share a root, by binary lifting.

    The deeper end climbs to the depth of the other, then both climb while they stay apart: one join per side
    and level, with rows for the pairs alone. ``levels`` are the ``jump_levels`` of the tree.
    """
    levels = jump_levels(tree) if levels is None else levels
    low = levels[-1].select("node", F.col("hops").alias("h"), F.col("length").alias("d"))
    named = tree.select("node", F.coalesce("name", "node").alias("id")).join(low, "node")
    side = lambda s: named.select(F.col("id").alias(s), *[F.col(c).alias(s + c) for c in ("node", "h", "d")])
    deep = F.col("ah") >= F.col("bh")
    p = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(
        "a",
        "b",
        F.when(deep, F.col("anode")).otherwise(F.col("bnode")).alias("x"),
        F.when(deep, F.col("bnode")).otherwise(F.col("anode")).alias("y"),
        F.abs(F.col("ah") - F.col("bh")).alias("gap"),
        (F.col("ad") + F.col("bd")).alias("sum"),
    )
    for j in reversed(range(len(levels))):
        climb = F.col("gap") >= F.lit(1 << j)
        up = levels[j].select(F.col("node").alias("x"), F.col("up").alias("ux"))
        p = p.join(up, "x", "left").select(
            "a", "b", F.when(climb, F.coalesce("ux", "x")).otherwise(F.col("x")).alias("x"), "y",
            (F.col("gap") - F.when(climb, F.lit(1 << j)).otherwise(F.lit(0))).alias("gap"), "sum",
        )
        p = cut(p) if j % 4 == 3 else p
    for j in reversed(range(len(levels))):
        ux = levels[j].select(F.col("node").alias("x"), F.col("up").alias("ux"))
        uy = levels[j].select(F.col("node").alias("y"), F.col("up").alias("uy"))
        apart = F.coalesce("ux", "x") != F.coalesce("uy", "y")
        p = p.join(ux, "x", "left").join(uy, "y", "left").select(
            "a", "b", F.when(apart, F.coalesce("ux", "x")).otherwise(F.col("x")).alias("x"),
            F.when(apart, F.coalesce("uy", "y")).otherwise(F.col("y")).alias("y"), "sum",
        )
        p = cut(p) if j % 4 == 3 else p
    one = levels[0]
    met = p.join(one.select(F.col("node").alias("x"), F.col("up").alias("ux")), "x", "left").join(
        one.select(F.col("node").alias("y"), F.col("up").alias("uy")), "y", "left"
    )
    shared = F.when(F.col("x") == F.col("y"), F.col("x")).when(
        F.coalesce("ux", "x") == F.coalesce("uy", "y"), F.coalesce("ux", "x")
    )
    met = met.select("a", "b", "sum", shared.alias("node")).where(F.col("node").isNotNull())
    return met.join(low.select("node", "d"), "node", "left").select(
        "a", "b", (F.col("sum") - 2 * F.coalesce("d", F.lit(0.0))).alias("dist")
    )


def _scores(above: DataFrame, labels: DataFrame) -> DataFrame:
    """``(run, score)``: mean between- over mean within-cluster distance of ``labels(run, parent, length, label)``.

    Tips are counted once, under their parents; an edge above a tip has a closed form. Only counts per
    (run, parent, label) meet the edges ``above`` inner nodes.
    """
    low = cut(
        labels.groupBy("run", "parent", "label")
        .agg(F.count("*").alias("s"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("tip_length"))
    )
    size = low.groupBy("run", "label").agg(F.sum("s").alias("n"))
    below = (
        low.join(above, "parent")
        .groupBy("run", "edge", "label")
        .agg(F.sum("s").alias("s"), F.max("length").alias("length"))
        .join(size, ["run", "label"])
    )
    s, n = F.col("s").cast("double"), F.col("n").cast("double")
    edges = below.groupBy("run", "edge").agg(
        F.max("length").alias("length"), F.sum(s * (n - s)).alias("within"), F.sum("s").cast("double").alias("all")
    )
    total = size.groupBy("run").agg(F.sum("n").cast("double").alias("total"), F.sum(pairs_of("n")).alias("wp"))
    at_tips = low.join(size, ["run", "label"]).groupBy("run").agg(
        F.sum(F.col("tip_length") * (F.col("n") - 1)).alias("tip_w"), F.sum("tip_length").alias("tip_length")
    )
    inner = edges.join(total.select("run", "total"), "run").groupBy("run").agg(
        F.sum(F.col("length") * F.col("within")).alias("inner_w"),
        F.sum(F.col("length") * F.col("all") * (F.col("total") - F.col("all"))).alias("inner_t"),
    )
    zero = F.lit(0.0)
    t = at_tips.join(total, "run").join(inner, "run", "left").select(
        "run",
        "total",
        "wp",
        (F.col("tip_w") + F.coalesce("inner_w", zero)).alias("w"),
        (F.col("tip_length") * (F.col("total") - 1) + F.coalesce("inner_t", zero)).alias("t"),
    )
    bp = pairs_of("total") - F.col("wp")
    between = F.when(bp > 0, (F.col("t") - F.col("w")) / bp)
    within = F.when(F.col("wp") > 0, F.col("w") / F.col("wp"))
    return t.select("run", (between / (within + F.lit(1e-12))).alias("score"))


def phylo_purity(
    tree: DataFrame, anc: DataFrame, labels: DataFrame, n_perm: int = 500, seed: int = 42, min_tips: int = 4
) -> DataFrame:
    """``Purity_between_over_within, Perm_P, N`` for ``labels(id, label)`` on the tree's tips.

    ``anc`` holds the ancestors of the inner nodes at least (``ancestors(inner_nodes(tree))``).
    The observed labeling is run -1 of the same grouped job as the permutations.
    """
    named = tips(tree).select(F.coalesce("name", "node").alias("id"), "parent", "length")
    kept = labels.join(named, "id", "left_semi").select("id", "label")
    edge = tree.where(F.col("parent").isNotNull()).select(F.col("node").alias("anc"), "length")
    above = anc.join(edge, "anc").select(F.col("node").alias("parent"), F.col("anc").alias("edge"), "length")
    # a tip's edge rides with its id, so that the permuted rows are counted where they are drawn
    tip = named.groupBy("id").agg(F.collect_list(F.struct("parent", "length")).alias("tip"))
    kept = cut(kept.join(tip, "id"))
    alone = kept.where(F.size("tip") > 1).isEmpty()
    if alone:
        kept = kept.select("id", "label", F.col("tip")[0]["parent"].alias("parent"), F.col("tip")[0]["length"].alias("length"))
    carry = ["parent", "length"] if alone else ["tip"]
    runs = kept.select(F.lit(-1).cast("bigint").alias("run"), "id", "label", *carry)
    if n_perm > 0:
        runs = runs.unionByName(permute_labels(kept, n_perm, seed, carry))
    runs = runs if alone else runs.select("run", "id", "label", F.inline("tip"))
    score = cut(_scores(above, runs))
    s0 = score.where("run = -1").agg(F.max("score").alias("s")).scalar()
    n = kept.agg(F.count("*").alias("n")).scalar()
    out = score.agg(
        F.max(F.when(F.col("run") == -1, F.col("score"))).alias("Purity_between_over_within"),
        F.count_if((F.col("run") >= 0) & (F.col("score") >= s0 - 1e-12)).alias("ge"),
    ).withColumn("N", n)
    p = F.when(F.col("Purity_between_over_within").isNotNull() & F.lit(n_perm > 0), (F.col("ge") + 1) / (n_perm + 1))
    return out.where(F.col("N") >= min_tips).select("Purity_between_over_within", p.alias("Perm_P"), "N")


def tree_from_levels(levels: Sequence[DataFrame]) -> DataFrame:
    """Tree from ``(node, parent)`` frames with unit branches (taxonomies)."""
    out = None
    for df in levels:
        part = df.select("node", "parent", F.lit(1.0).alias("length"), F.col("node").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out
