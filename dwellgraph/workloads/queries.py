"""Registered queries: every operator over whole tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.clock import STAMP, epoch
from ..operators import dimensions, drift, embedding, graph, meetings, pingpong, places, regions, stays, walks
from ..operators.ranks import ranked
from ..plans import cleaning, embedding as plan
from ..session import cut, shared_dir
from ..sources import lines, sinks
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _plain(df: DataFrame) -> DataFrame:
    """Times as epoch seconds and positions at 6 decimals, so that engines can be compared."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            out.append(epoch(name).alias(name.replace("_ts", "_s") if name != "ts" else "s"))
        elif name in ("lon", "lat"):
            out.append(F.round(name, 6).alias(name))
        elif kind == "double":
            out.append(F.round(name, 10).alias(name))
        else:
            out.append(F.col(name))
    return df.select(out)


def _records(spark, d, adjacency=None):
    return cleaning.locate(T.call_records(spark, d), None, T.cell_alias(spark, d), T.cells(spark, d), adjacency)


def _steps(spark, d, *steps, adjacency=None):
    """A chain of trajectory steps on the located records; hot users are looked for in the events themselves."""
    return cleaning.user_steps(_records(spark, d, adjacency), *steps, probe=T.call_records(spark, d).select("user"))


def _run(df, o):
    return stays.runs(df, o, T.STAY_GAP)


def _merge(df, o):
    return stays.merged(df, o, T.MERGE_GAP)


def _stays(spark, d):
    return _steps(spark, d, _run)


def _merged(spark, d):
    return _steps(spark, d, _run, _merge)


def _calm(spark, d, adjacency=None, **options):
    return _steps(spark, d, _run, lambda x, o: drift.without_drift(x, o, **T.DRIFT | options), adjacency=adjacency)


# Sources: the parsers read lines that Spark renders from the tables.

@query
def cdr_lines(spark, d):
    """Five-field lines; records with an odd cell get a sixth field and must be dropped, empty ends do not count."""
    r = T.call_records(spark, d)
    odd = F.col("cid").cast("long") % 2 == 1
    tail = F.when(odd, ",x").otherwise(",,")
    text = F.concat(F.lit("0,"), F.date_format("ts", STAMP), F.lit(",-,"), "user", F.lit(","), "cid", tail)
    return _plain(lines.parse_cdr(r.select(text.alias("value"))))


@query
def user_lines(spark, d):
    r = T.call_records(spark, d).select(F.concat_ws(",", "user", "cid").alias("value"))
    return lines.parse_users(r)


@query
def alias_lines(spark, d):
    return lines.parse_alias(T.cell_alias(spark, d).select(F.concat_ws(",", "cid", "canon_cid").alias("value")))


@query
def cell_lines(spark, d):
    c = T.stations(spark, d)
    blanks = [F.lit("-")] * 4
    text = F.concat_ws(",", *blanks[:3], "cid", *blanks[:3], F.concat(F.lit("s"), "cid"), *blanks, "lon", "lat")
    return _plain(lines.parse_cells(c.select(text.alias("value"))))


@query
def adjacency_lines(spark, d):
    """Nations and the list of their suppliers; the line of the largest nation key of a region counts."""
    s = T.table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: k.cast("string")), ",").alias("l"))
    n = T.table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    numbered = n.select(F.concat_ws("\t", F.col("n_regionkey").cast("string"), "l").alias("value"),
                        F.col("n_nationkey").alias(lines.LINE))
    return lines.parse_adjacency(numbered)


@query
def stay_file_lines(spark, d):
    """Merged stays written as text and read back; empty fields at the end of a line do not count."""
    text = sinks.stay_lines(_merged(spark, d))
    return _plain(lines.parse_stays(text.select(F.concat("value", F.when(F.col("value").like("1%"), ",,").otherwise("")).alias("value"))))


@query
def stay_file_default_count(spark, d):
    return _plain(lines.parse_stays(sinks.stay_lines(_stays(spark, d)), default_count=1))


@query
def edge_lines(spark, d):
    e = T.edges(spark, d).select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"),
                                             F.col("weight").cast("string")).alias("value"))
    return lines.parse_edges(e, weighted=True)


@query
def location_keys(spark, d):
    text = T.spots(spark, d).select(F.concat_ws(",", "lon", "lat", "uid").alias("value"))
    return places.location_key(lines.parse_locations(text)).select("location_key")


@query
def location_keys_exact(spark, d):
    """Keys of positions with seven decimals, many of which end in a five."""
    k = F.col("c_custkey").cast("long")
    spots = T.table(spark, d, "customer").select((F.lit(110.0) + (k * 7919 % 20000000) / 1e7).alias("lon"), (((k * 104729 % 400000) * 10 + 5) / 1e7 - 0.02).alias("lat"), k.alias("c_custkey"))
    return places.location_key(spots).select("c_custkey", "location_key")


# Lookups and gates.

@query
def cdr_located(spark, d):
    return _plain(_records(spark, d))


@query
def users_semi(spark, d):
    return _plain(dimensions.filter_users(T.call_records(spark, d), T.listed_users(spark, d)))


@query
def alias_join(spark, d):
    return _plain(dimensions.canonicalize_cells(T.call_records(spark, d), T.cell_alias(spark, d)).select("user", "ts", "cid"))


@query
def min_rows(spark, d):
    return _plain(_steps(spark, d, lambda x, o: stays.more_than(x, o, T.MIN_RECORDS)))


@query
def ordered_trace(spark, d):
    """Each row with its position among the rows of its user, as they lie in the output."""
    placed = stays.order_trace(_records(spark, d)).withColumn("_at", F.monotonically_increasing_id())
    return _plain(placed.withColumn("position", F.row_number().over(Window.partitionBy("user").orderBy("_at"))).drop("_at"))


@query
def time_sorted(spark, d):
    """Each row with whether it lies behind no later row of its user in the output."""
    placed = _plain(stays.sort_by_time(T.call_records(spark, d))).withColumn("_at", F.monotonically_increasing_id())
    before = F.lag("s").over(Window.partitionBy("user").orderBy("_at"))
    return placed.withColumn("in_order", F.coalesce(F.col("s") >= before, F.lit(True))).drop("_at")


# Trajectories.

@query
def stay_runs(spark, d):
    return _plain(_stays(spark, d))


@query
def stay_runs_keep_last(spark, d):
    return _plain(_steps(spark, d, lambda x, o: stays.runs(x, o, T.STAY_GAP, keep_last=True)))


@query
def segments(spark, d):
    return _plain(_steps(spark, d, _run, lambda x, o: stays.segments(x, o, T.DRIFT["gap_s"])))


@query
def drift_removed(spark, d):
    return _plain(_calm(spark, d))


@query
def drift_adjacent(spark, d):
    return _plain(_calm(spark, d, adjacency=T.neighbours(spark, d)))


@query
def drift_isolated_rule(spark, d):
    return _plain(_calm(spark, d, isolated_rule=True, point_ratio=0.9))


@query
def drift_true_share(spark, d):
    """A limit of the share at which it decides about some clusters."""
    return _plain(_calm(spark, d, true_share=True, cluster_s=40_000, max_share=0.34))


@query
def station_scores(spark, d):
    s = _steps(spark, d, _run, lambda x, o: pingpong.scored(x, o, T.PINGPONG_GAP))
    return s.select("user", "group_id", "cid", "freq", F.round("score", 6).alias("score"))


@query
def pingpong_collapsed(spark, d):
    return _plain(_steps(spark, d, _run, lambda x, o: pingpong.collapsed(x, o, T.PINGPONG_GAP)))


@query
def merge_stays(spark, d):
    return _plain(_merged(spark, d))


@query
def merge_stays_exact(spark, d):
    return _plain(_steps(spark, d, _run, lambda x, o: stays.merged(x, o, T.MERGE_GAP, exact_count=True)))


@query
def residence_points(spark, d):
    return _plain(_steps(spark, d, _run, stays.residences))


def _regions(spark, d):
    return _steps(spark, d, _run, _merge, lambda x, o: regions.looped(x, o, T.REGION_GAP))


@query
def region_merge(spark, d):
    r = _regions(spark, d)
    cells = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["cid"], c["n"].cast("string"))), ",")
    return _plain(r.withColumn("cells", cells))


@query
def region_cells(spark, d):
    return _plain(regions.region_cells(_regions(spark, d)))


@query
def region_lines(spark, d):
    return regions.region_lines(_regions(spark, d))


@query
def clean_traces(spark, d):
    """The whole cleaning pipeline: user list, alias, positions, all trajectory steps and gates."""
    return _plain(cleaning.clean_traces(
        T.call_records(spark, d), T.listed_users(spark, d), T.cell_alias(spark, d), T.cells(spark, d),
        T.neighbours(spark, d), T.CLEANING,
    ))


@query
def trajectory_lines(spark, d):
    return sinks.stay_lines(_stays(spark, d))


# Graphs.

def _graph(spark, d):
    return graph.build_graph(T.edges(spark, d))


@query
def graph_undirected(spark, d):
    return _graph(spark, d)


@query
def graph_directed(spark, d):
    return graph.build_graph(T.edges(spark, d), directed=True)


@query
def graph_unweighted_nodes(spark, d):
    return graph.nodes(graph.build_graph(T.edges(spark, d), weighted=False))


@query
def threshold_edges(spark, d):
    return graph.threshold_edges(_graph(spark, d), 40.0)


@query
def threshold_graphs(spark, d):
    return graph.threshold_graphs(_graph(spark, d), T.THRESHOLDS)


@query
def weight_quartiles(spark, d):
    return _plain(graph.weight_thresholds(_graph(spark, d)))


@query
def adjacency(spark, d):
    a = graph.adjacency(_graph(spark, d))
    nbrs = F.transform("nbrs", lambda n: F.concat_ws(":", n["nbr"].cast("string"), n["weight"].cast("long").cast("string")))
    return a.select("node", "block", F.array_join(nbrs, ",").alias("nbrs"))


@query
def node_transitions(spark, d):
    return _plain(graph.node_transitions(_graph(spark, d)))


@query
def edge_transitions(spark, d):
    return _plain(graph.edge_transitions(_graph(spark, d), p=0.5, q=2.0))


@query
def step_probabilities(spark, d):
    """The steps src -> dst -> nbr after each edge of the graph: their number, and the sum of squares and the largest of their probabilities."""
    g = _graph(spark, d)
    found = graph.step_probabilities(g.select("src", "dst"), g, graph.edge_transitions(g, p=0.5, q=2.0))
    return _plain(found.groupBy("src", "dst").agg(F.count("nbr").alias("n"), F.sum(F.col("prob") * F.col("prob")).alias("squares"), F.max("prob").alias("largest")))


@query
def edge_transitions_directed(spark, d):
    return _plain(graph.edge_transitions(graph.build_graph(T.edges(spark, d), directed=True), p=0.25, q=4.0))


def _paths(w: DataFrame) -> DataFrame:
    path = F.array_join(F.transform("path", lambda n: n.cast("string")), " ")
    return w.select("graph", "start", "walk", path.alias("path"))


@query
def walks_first_order(spark, d):
    return _paths(walks.random_walks(_graph(spark, d), num_walks=2, walk_length=20, seed=7))


@query
def walks_default(spark, d):
    """The stated workload: 10 walks of 80 nodes from every node."""
    return _paths(walks.random_walks(_graph(spark, d), seed=11))


@query
def walks_second_order(spark, d):
    return _paths(walks.random_walks(_graph(spark, d), num_walks=1, walk_length=10, p=0.5, q=2.0, seed=7))


@query
def walks_directed(spark, d):
    """Walks end at nodes that no edge leaves."""
    g = graph.build_graph(T.edges(spark, d), directed=True)
    return _paths(walks.random_walks(g, num_walks=2, walk_length=10, p=2.0, q=0.5, seed=3))


@query
def walks_thresholds(spark, d):
    g = graph.threshold_graphs(_graph(spark, d), T.THRESHOLDS)
    return _paths(walks.random_walks(g, num_walks=1, walk_length=10, seed=7))


@query
def corpus_order(spark, d):
    """The order in which the walks of the stated workload, ten from every node of four graphs, enter the corpus."""
    return walks.corpus_order(walks.starts(graph.threshold_graphs(_graph(spark, d), T.THRESHOLDS)), seed=7)


@query
def embeddings(spark, d):
    """Vectors of all nodes from walks over the graph and its threshold sub-graphs."""
    g = graph.threshold_graphs(_graph(spark, d), T.THRESHOLDS)
    w = walks.random_walks(g, num_walks=1, walk_length=10, seed=7)
    v = embedding.embed_walks(w, dimensions=32, window_size=5, workers=4, seed=7)
    return _vector_facts(v, _graph(spark, d))


def _closer(v: DataFrame, g: DataFrame, heavy: float) -> bool:
    """Whether the ends of heavy edges have a larger mean cosine than nodes that follow each other in the order of a hash."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda total, z: total + z)

    cosine = F.avg(dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y")))
    left, right = v.select(F.col("node").alias("src"), F.col("vector").alias("x")), v.select(F.col("node").alias("dst"), F.col("vector").alias("y"))
    near = g.filter((F.col("weight") > heavy) & (F.col("src") != F.col("dst"))).join(left, "src").join(right, "dst").agg(cosine)
    placed = ranked(v.select(F.lit(0).alias("all"), F.xxhash64("node").alias("h"), "vector"), "all", ["h"])
    after = placed.select((F.col("_rank") - 1).alias("_rank"), F.col("vector").alias("y"))
    apart = placed.select("_rank", F.col("vector").alias("x")).join(after, "_rank").agg(cosine)
    return near.first()[0] > apart.first()[0]


def _vector_facts(v: DataFrame, g: DataFrame) -> DataFrame:
    """What is determined of trained vectors: their sizes, and that neighbours are closer than other nodes, which vectors without training are not."""
    v = cut(v)
    closer = F.lit(_closer(v, g, heavy=45.0))
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.select("node", F.size("vector").alias("dimensions"), finite.alias("finite"), F.exists("vector", lambda x: x != 0).alias("nonzero"), closer.alias("neighbours_closer"))


@query
def embed_graph(spark, d):
    """The whole pipeline over four graphs at the stated size: ten walks of 80 nodes from each node, 128 dimensions, window 10."""
    v = plan.embed_graph(T.edges(spark, d), plan.EmbeddingConfig(weighted=True, thresholds=tuple(T.THRESHOLDS), seed=7))
    return _vector_facts(v, _graph(spark, d))


@query
def embedding_lines(spark, d):
    v = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    return sinks.embedding_lines(v).select("value")


# Places.

@query
def poi_flatten(spark, d):
    return places.flatten_nearby(T.nearby_responses(spark, d))


@query
def poi_descriptions(spark, d):
    return places.describe_pois(places.flatten_nearby(T.nearby_responses(spark, d)))


@query
def poi_distinct(spark, d):
    return places.distinct_uids(places.flatten_nearby(T.nearby_responses(spark, d)))


@query
def place_details(spark, d):
    out = places.flatten_details(T.detail_responses(spark, d))
    return out.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query
def stored_responses(spark, d):
    """Responses of all parts stored as a file each and read back by their file names."""
    folder = f"{shared_dir(spark).rstrip('/')}/responses-{uuid.uuid4().hex}"
    sinks.write_responses(T.detail_responses(spark, d), folder, key="uid")
    out = places.flatten_details(lines.read_responses(spark, folder, key="uid", encoded=True))
    return out.withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


@query
def place_detail_lines(spark, d):
    return places.detail_lines(places.flatten_details(T.detail_responses(spark, d)))


@query
def pois_within(spark, d):
    return places.pois_within(T.stations(spark, d), T.spots(spark, d), radius_m=400)


@query
def signed_requests(spark, d):
    """Requests for every text of the benchmark table, which has spaces, accents and punctuation."""
    b = T.table(spark, d, "benchmark").select("item_id", F.col("text").alias("uid"))
    return places.signed_requests(b, places.detail_request("key"), "secret", "http://example.org").select("item_id", "sn", "url")


@query
def signed_locations(spark, d):
    s = places.location_key(T.spots(spark, d))
    return places.signed_requests(s, places.nearby_request("key"), "secret", "http://example.org").select("uid", "sn", "url")


@query
def user_meetings(spark, d):
    return meetings.meetings(_stays(spark, d))


@query
def user_meetings_gap(spark, d):
    """Pairs of stays of which one begins at most two days after the other's end."""
    return meetings.meetings(_stays(spark, d), max_gap_s=172_800)
