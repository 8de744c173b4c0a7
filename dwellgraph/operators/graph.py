"""Graphs as edge tables: build, thresholds, adjacency, transition probabilities.

A graph is a frame (src, dst, weight), undirected ones with both directions; an optional leading column
``graph`` holds several graphs in one frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..defaults import EDGE_THRESHOLDS, HOT_ROWS
from ..session import cut, stored
from .ordered import per_key
from .spread import merged
from .triangles import triangles



def graph_key(g: DataFrame, *cols: str) -> list[str]:
    return [*(["graph"] if "graph" in g.columns else []), *cols]


def build_graph(edges: DataFrame, weighted: bool = True, directed: bool = False, merge: str = "larger_source") -> DataFrame:
    """Edge list (src, dst, weight[, seq]) to a graph.

    Of a repeated pair the last by seq counts. Undirected: the two directions of a pair become one weight,
    that of the direction with the larger source id; or their max, min or sum.
    """
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    order = F.struct("seq", "weight") if "seq" in edges.columns else F.struct("weight")
    e = edges.select("src", "dst", weight.alias("weight"), order.alias("_o"))
    if directed:
        return e.groupBy("src", "dst").agg(F.max_by("weight", "_o").alias("weight"))
    up = F.col("src") <= F.col("dst")
    pairs = e.groupBy(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(
        F.max_by("weight", F.when(up, F.col("_o"))).alias("_up"),
        F.max_by("weight", F.when(~up, F.col("_o"))).alias("_down"),
    )
    rules = {
        "larger_source": F.coalesce("_down", "_up"),
        "max": F.greatest("_up", "_down"),
        "min": F.least("_up", "_down"),
        "sum": F.coalesce("_up", F.lit(0.0)) + F.coalesce("_down", F.lit(0.0)),
    }
    both = F.array_distinct(F.array(F.struct(F.col("_a").alias("src"), F.col("_b").alias("dst")),
                                    F.struct(F.col("_b").alias("src"), F.col("_a").alias("dst"))))
    return pairs.select(F.explode(both).alias("_e"), rules[merge].alias("weight")).select("_e.src", "_e.dst", "weight")


def nodes(g: DataFrame) -> DataFrame:
    """All endpoints."""
    ends = F.explode(F.array("src", "dst")).alias("node")
    return g.select(*graph_key(g), ends).distinct()


def threshold_edges(g: DataFrame, threshold: float) -> DataFrame:
    return g.filter(F.col("weight") > threshold)


def threshold_graphs(g: DataFrame, thresholds=EDGE_THRESHOLDS) -> DataFrame:
    """The graph (graph 0) and its sub-graphs with weight > threshold (graphs 1, 2, ...) in one frame."""
    kept = F.array(
        F.struct(F.lit(0).alias("graph"), F.lit(None).cast("double").alias("threshold")),
        *[F.struct(F.lit(i).alias("graph"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds, 1)],
    )
    kept = F.filter(kept, lambda t: t["threshold"].isNull() | (F.col("weight") > t["threshold"]))
    return g.select(F.explode(kept).alias("_t"), "src", "dst", "weight").select("_t.graph", "src", "dst", "weight")


def weight_thresholds(edges: DataFrame, probabilities=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles of the weights, interpolated: probability, weight.

    Equal weights are counted first. The distinct ones are range-partitioned, and one row for each partition carries how many weights lie before it; all
    wanted ranks are then looked up at once, each in the partition that holds it. No task sees all weights, and the number of jobs does not depend on
    the number of quantiles. Null weights do not count; -inf comes first, then inf and NaN last, and between two different non-finite neighbours the upper
    one is taken. Without weights there is no row.
    """
    counts = edges.filter("weight IS NOT NULL").groupBy("weight").agg(F.count(F.lit(1)).alias("_c"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, "weight").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    pieces = placed.groupBy("_part").agg(F.sum("_c").alias("_rows")).withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_all": F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    here = Window.partitionBy("_part").orderBy("weight").rowsBetween(Window.unboundedPreceding, 0)
    x = placed.join(pieces, "_part").withColumn("_end", F.col("_before") + F.sum("_c").over(here))

    def wanted(p):
        at = (F.col("_all") - 1) * F.lit(float(p))
        held = lambda rank: (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
        return F.struct(F.lit(float(p)).alias("p"), at.alias("at"), held(F.floor(at)).alias("low"), held(F.ceil(at)).alias("high"))

    hits = F.filter(F.array(*[wanted(p) for p in probabilities]), lambda w: w["low"] | w["high"])
    x = x.select("weight", F.explode(hits).alias("_w")).groupBy(F.col("_w.p").alias("probability"), F.col("_w.at").alias("_at")).agg(
        F.max(F.when(F.col("_w.low"), F.col("weight"))).alias("_a"), F.max(F.when(F.col("_w.high"), F.col("weight"))).alias("_b"))
    plain = F.abs("_a").cast("string").isin("Infinity", "NaN") | F.abs("_b").cast("string").isin("Infinity", "NaN")
    between = F.when((F.col("_a") == F.col("_b")) | plain, F.col("_b")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at")))
    return x.select("probability", between.alias("weight"))


def node_transitions(g: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """First-order probabilities: add prob = weight / sum of the weights leaving src."""
    def body(d, o):
        total = o.totals(d, [], sums={"_total": "weight"})
        return total.withColumn("prob", F.col("weight") / F.col("_total")).drop("_total")

    return per_key(g, graph_key(g, "src"), ["dst"], body, hot_rows)


def adjacency(g: DataFrame, block: int = 1024, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Neighbours sorted by id in blocks of bounded length: node, block, nbrs[nbr, weight].

    All but nodes of very high degree have the single block 0.
    """
    def body(d, o):
        ranked = o.running(d, ["dst"], sums={"_rank": F.lit(1)})
        number = F.floor((F.col("_rank") - 1) / block).cast("int")
        nbrs = F.array_sort(F.collect_list(F.struct(F.col("dst").alias("nbr"), "weight")))
        return ranked.groupBy(*o.keys, number.alias("block")).agg(nbrs.alias("nbrs"), *o.slice_columns())

    return per_key(g, graph_key(g, "src"), ["dst"], body, hot_rows).withColumnRenamed("src", "node")


def closing_edges(g: DataFrame) -> DataFrame:
    """Directed edges src -> dst with the neighbours nbr of dst that have an edge back to src.

    Edges are oriented towards the end of higher degree, so no node of a graph with m edges has more than
    sqrt(2 m) of them, however many neighbours it has in all, and every triangle of the underlying undirected
    graph is found once, at its middle corner.
    """
    key = graph_key(g)
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    up = F.col("src") < F.col("dst")
    pairs = g.filter("src != dst").groupBy(*key, a.alias("u"), b.alias("v")).agg(
        F.max(F.when(up, F.col("weight"))).alias("uv"), F.max(F.when(~up, F.col("weight"))).alias("vu")
    )
    degrees = (
        pairs.select(*key, F.explode(F.array("u", "v")).alias("node")).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("deg"))
    )
    ranked = pairs
    for end in ("u", "v"):
        ranked = ranked.join(merged(degrees.withColumnsRenamed({"node": end, "deg": f"_{end}"})), [*key, end])
    forward = F.struct("_u", "u") < F.struct("_v", "v")
    # From the lower-degree end lo to the higher-degree end hi, whose degree is the order; out and back are the weights of the two directions.
    arcs = stored(ranked.select(
        *key,
        F.when(forward, F.col("u")).otherwise(F.col("v")).alias("lo"),
        F.when(forward, F.col("v")).otherwise(F.col("u")).alias("hi"),
        F.when(forward, F.col("uv")).otherwise(F.col("vu")).alias("out"),
        F.when(forward, F.col("vu")).otherwise(F.col("uv")).alias("back"),
        F.when(forward, F.col("_v")).otherwise(F.col("_u")).alias("order"),
    ))
    corners = triangles(arcs, key)

    def turn(src: str, dst: str, nbr: str, first: str, weight: str, closes: str) -> Column:
        exists = F.col(first).isNotNull() & F.col(weight).isNotNull() & F.col(closes).isNotNull()
        return F.when(exists, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(nbr).alias("nbr"),
                                       F.col(weight).alias("weight")))

    turns = F.array(
        turn("lo", "x", "y", "lx", "xy", "yl"), turn("x", "y", "lo", "xy", "yl", "lx"), turn("y", "lo", "x", "yl", "lx", "xy"),
        turn("lo", "y", "x", "ly", "yx", "xl"), turn("y", "x", "lo", "yx", "xl", "ly"), turn("x", "lo", "y", "xl", "ly", "yx"),
    )
    return corners.select(*key, F.explode(F.array_compact(turns)).alias("_t")).select(*key, "_t.*")


def edge_transitions(g: DataFrame, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """Second-order probabilities after an edge src -> dst: (src, dst, nbr, prob).

    The weight of a neighbour counts 1/p if it is src, 1 if it has an edge to src, else 1/q. Listing every
    neighbour for every edge would take the sum of all squared degrees, so only the first two kinds have
    rows of their own; one row with a NULL nbr gives the probability per unit of weight of all others.
    ``step_probabilities`` puts the two together.
    """
    key = graph_key(g)
    edge = [*key, "src", "dst"]
    g = stored(g.select(*key, "src", "dst", "weight"))  # read many times below
    loop = F.when(F.col("src") == F.col("dst"), F.col("weight"))
    leaving = g.groupBy(*key, F.col("src").alias("dst")).agg(F.sum("weight").alias("_out"), F.max(loop).alias("_loop"))
    back = g.filter("src IS NOT NULL AND dst IS NOT NULL").select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_back"))
    # A self-loop at src is met as the return to src, or has no third corner to close. After a self-loop src is dst: x has an edge to src if x -> dst exists.
    near = stored(closing_edges(g).unionByName(_mutual_of_loops(g)))  # the dearest step, read twice
    # What is known of an edge goes through one exchange.
    unknown = F.lit(None).cast("double")
    known = back.withColumn("_near", unknown).unionByName(near.select(*edge, unknown.alias("_back"), F.col("weight").alias("_near")))
    known = known.groupBy(*edge).agg(F.max("_back").alias("_back"), F.sum("_near").alias("_near"))
    e = g.select(*edge).join(merged(leaving), [*key, "dst"]).join(merged(known), edge, "left")
    # dst's own loop leads to dst, which has an edge to src exactly if the return edge exists.
    own = F.when((F.col("src") != F.col("dst")) & F.col("_back").isNotNull(), F.col("_loop"))
    e = e.withColumns({"_own": own, "_back": F.coalesce("_back", F.lit(0.0)), "_near": F.coalesce("_near", F.lit(0.0))})
    unit = F.col("_near") + F.coalesce("_own", F.lit(0.0))
    norm = (F.col("_out") - F.col("_back") - unit) / q + F.col("_back") / p + unit
    norms = stored(e.select(*edge, norm.alias("_norm"), "_back", "_own"))
    returns = norms.filter("_back > 0").select(*edge, F.col("src").alias("nbr"), (F.col("_back") / p / F.col("_norm")).alias("prob"))
    own = norms.filter("_own IS NOT NULL").select(*edge, F.col("dst").alias("nbr"), (F.col("_own") / F.col("_norm")).alias("prob"))
    others = norms.select(*edge, F.lit(None).cast("long").alias("nbr"), (1.0 / q / F.col("_norm")).alias("prob"))
    near = near.join(merged(norms), edge).select(*edge, "nbr", (F.col("weight") / F.col("_norm")).alias("prob"))
    return returns.unionByName(own).unionByName(near).unionByName(others)


def near_neighbours(g: DataFrame) -> DataFrame:
    """Edges src -> dst with the neighbours nbr of dst, other than src, that have an edge to src: src, dst, nbr, weight (of dst -> nbr)."""
    key = graph_key(g)
    g = stored(g.select(*key, "src", "dst", "weight"))
    back = g.filter("src != dst").select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"))
    # dst's own loop leads to dst, which has an edge to src exactly if the return edge exists.
    loops = g.filter("src = dst").select(*key, "dst", F.col("dst").alias("nbr"), "weight")
    own = g.filter("src != dst").select(*key, "src", "dst").join(merged(back), [*key, "src", "dst"], "left_semi").join(merged(loops), [*key, "dst"])
    return closing_edges(g).unionByName(own).unionByName(_mutual_of_loops(g))


def _mutual_of_loops(g: DataFrame) -> DataFrame:
    """For a self-loop src -> src: the other neighbours of src that have an edge back to it."""
    key = graph_key(g)
    loops = g.filter("src = dst").select(*key, "src")
    out = g.filter("src != dst").join(merged(loops), [*key, "src"], "left_semi")
    back = g.select(*key, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = out.join(merged(back), [*key, "src", "dst"], "left_semi")
    return mutual.select(*key, "src", F.col("src").alias("dst"), F.col("dst").alias("nbr"), "weight")


def step_probabilities(steps: DataFrame, g: DataFrame, transitions: DataFrame) -> DataFrame:
    """Second-order probability of given steps (src, dst, nbr); without a column nbr, of all steps after the given edges (src, dst)."""
    edge = graph_key(g, "src", "dst")
    if "nbr" not in steps.columns:
        return _all_step_probabilities(steps, g, transitions)
    weights = g.select(*graph_key(g), F.col("src").alias("dst"), F.col("dst").alias("nbr"), F.col("weight").alias("_w"))
    named = transitions.filter("nbr IS NOT NULL").withColumnRenamed("prob", "_named")
    unit = transitions.filter("nbr IS NULL").select(*edge, F.col("prob").alias("_unit"))
    return (
        steps.join(merged(weights), graph_key(g, "dst", "nbr")).join(merged(unit), edge).join(merged(named), [*edge, "nbr"], "left")
        .select(*edge, "nbr", F.coalesce("_named", F.col("_w") * F.col("_unit")).alias("prob"))
    )


def _all_step_probabilities(edges: DataFrame, g: DataFrame, transitions: DataFrame) -> DataFrame:
    """Steps after edges come up last, in the join of an edge with the neighbours of its end, and go through no exchange: an edge brings its own probabilities along in two lists."""
    key = graph_key(g)
    edge = [*key, "src", "dst"]
    parts = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not coalesced by their few bytes
    step = F.when(F.col("nbr").isNotNull(), F.struct("nbr", "prob"))
    known = transitions.groupBy(*edge).agg(F.max(F.when(F.col("nbr").isNull(), F.col("prob"))).alias("_unit"), F.collect_list(step).alias("_named")).filter("_unit IS NOT NULL")
    known = edges.select(*edge).join(merged(known), edge).select(*edge, "_unit", F.col("_named.nbr").alias("_nbrs"), F.col("_named.prob").alias("_probs"))
    weights = g.select(*key, F.col("src").alias("dst"), F.col("dst").alias("nbr"), F.col("weight").alias("_w")).filter("nbr IS NOT NULL")
    found = known.repartition(parts, *key, "dst").join(merged(weights.repartition(parts, *key, "dst")), [*key, "dst"])
    named = F.get("_probs", (F.array_position("_nbrs", F.col("nbr")) - 1).cast("int"))
    return found.select(*edge, "nbr", F.coalesce(named, F.col("_w") * F.col("_unit")).alias("prob"))
