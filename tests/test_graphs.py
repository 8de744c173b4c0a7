import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from dwellgraph import defaults
from dwellgraph.operators import graph as G
from dwellgraph.operators import embedding, triangles, walks as W
from dwellgraph.operators.embedding import embed_walks
from dwellgraph.plans.embedding import EmbeddingConfig, embed_graph
from dwellgraph.session import CLEANUP, stored

EDGES = "src long, dst long, weight double"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], EDGES)


def naive_second_order(g, p, q):
    out = {}
    for n in g:
        out.setdefault(n[0], {})[n[1]] = g[n]
    probs = {}
    for s, d in g:
        raw = {x: w / p if x == s else w if (x, s) in g else w / q for x, w in out.get(d, {}).items()}
        for x, w in raw.items():
            probs[s, d, x] = w / sum(raw.values())
    return probs


@pytest.fixture(scope="module")
def random_edges():
    rnd = random.Random(4)
    return {(rnd.randrange(12), rnd.randrange(12)): float(rnd.randint(1, 9)) for _ in range(60)}


def test_build(spark):
    e = spark.createDataFrame([(1, 2, 3.0, 1), (1, 2, 5.0, 2), (2, 1, 7.0, 0), (3, 1, 2.0, 0), (4, 4, 1.0, 0)], EDGES + ", seq int")
    def weights(g):
        return {(r.src, r.dst): r.weight for r in g.collect()}
    assert weights(G.build_graph(e)) == {(1, 2): 7, (2, 1): 7, (1, 3): 2, (3, 1): 2, (4, 4): 1}
    assert weights(G.build_graph(e, directed=True)) == {(1, 2): 5, (2, 1): 7, (3, 1): 2, (4, 4): 1}
    assert weights(G.build_graph(e, merge="sum"))[1, 2] == 12 and weights(G.build_graph(e, merge="min"))[1, 2] == 5
    assert set(weights(G.build_graph(e, weighted=False)).values()) == {1.0}


def test_golden_second_order(spark):
    g = G.build_graph(edges(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)]))
    t = G.edge_transitions(g, p=2.0, q=0.5)
    steps = spark.createDataFrame([(1, 3, n) for n in (1, 2, 4)], "src long, dst long, nbr long")
    got = {r.nbr: r.prob for r in G.step_probabilities(steps, g, t).collect()}
    assert [round(got[n], 6) for n in (1, 2, 4)] == [round(x / 7, 6) for x in (1, 2, 4)]


@pytest.mark.parametrize("directed", [False, True])
def test_second_order_against_definition(spark, random_edges, directed):
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]), directed=directed)
    table = {(r.src, r.dst): r.weight for r in g.collect()}
    want = naive_second_order(table, 0.25, 4.0)
    steps = spark.createDataFrame(list(want), "src long, dst long, nbr long")
    got = {(r.src, r.dst, r.nbr): r.prob for r in G.step_probabilities(steps, g, G.edge_transitions(g, 0.25, 4.0)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_adjacency_and_first_order_of_a_hub(spark):
    g = G.build_graph(edges(spark, [(0, i, i) for i in range(1, 61)]))
    whole, sliced = G.adjacency(g, block=25), G.adjacency(g, block=25, hot_rows=20)
    assert whole.exceptAll(sliced).isEmpty() and sliced.count() == 63
    assert max(len(r.nbrs) for r in sliced.collect()) == 25
    first = G.node_transitions(g, hot_rows=20)
    assert all(abs(r.s - 1) < 1e-12 for r in first.groupBy("src").agg(F.sum("prob").alias("s")).collect())
    assert W.intervals(g.withColumn("graph", F.lit(0)), 20).exceptAll(W.intervals(g.withColumn("graph", F.lit(0)), None)).isEmpty()


def test_quantiles(spark):
    rnd = random.Random(2)
    values = [rnd.choice([5.0, rnd.random() * 1000]) for _ in range(3001)]
    e = edges(spark, [(i, i + 1, v) for i, v in enumerate(values)])
    got = {r.probability: r.weight for r in G.weight_thresholds(e).collect()}
    want = e.agg(F.percentile("weight", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))).first()[0]
    assert all(abs(got[p] - w) < 1e-9 for p, w in zip((0.25, 0.5, 0.75), want))


def test_quantiles_of_odd_weights(spark):
    def quantiles(values, *p):
        df = spark.createDataFrame([(1, k, w) for k, w in enumerate(values)], EDGES)
        return {r.probability: r.weight for r in G.weight_thresholds(df, p).collect()}

    inf = float("inf")
    assert quantiles([], 0.5) == {} == quantiles([None, None], 0.5)
    assert quantiles([3.0], 0.0, 0.5, 1.0) == {0.0: 3.0, 0.5: 3.0, 1.0: 3.0}
    assert quantiles([inf, 1.0, -inf, None], 0.0, 0.25, 0.5, 0.75, 1.0) == {0.0: -inf, 0.25: 1.0, 0.5: 1.0, 0.75: inf, 1.0: inf}
    many = [float(k % 7) for k in range(100)]
    assert quantiles(many, *[k / 100 for k in range(101)]).keys() == {k / 100 for k in range(101)}


def test_corpus_order(spark, random_edges):
    g = G.threshold_graphs(G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()])), (3.0,))
    starts = W.starts(g, 3)
    one, again, other = (sorted((r.position, r.graph, r.walk, r.start) for r in W.corpus_order(s, seed).collect())
                         for s, seed in ((starts, 1), (starts.repartition(5), 1), (starts, 2)))
    assert one == again != other and [r[0] for r in one] == list(range(len(one))) == list(range(starts.count()))
    assert [r[1:3] for r in one] == sorted(r[1:3] for r in one) == sorted(r[1:3] for r in other)
    walks = W.random_walks(g, num_walks=3, walk_length=3)
    assert sorted((r.position, r.graph, r.walk, r.start) for r in W.corpus_order(walks, 1).collect()) == one


def test_walk_invariants(spark, random_edges):
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]))
    many = G.threshold_graphs(g, (3.0, 100.0))
    w = W.random_walks(many, num_walks=2, walk_length=9, p=0.5, q=2.0, seed=1).collect()
    per_graph = [[(r.src, r.dst) for r in many.filter(F.col("graph") == i).collect()] for i in range(3)]
    nodes = [{n for e in part for n in e} for part in per_graph]
    assert len(w) == 2 * sum(map(len, nodes)) and not nodes[2]
    for r in w:
        assert r.path[0] == r.start and len(r.path) == 9
        assert all(step in per_graph[r.graph] for step in zip(r.path, r.path[1:]))
    moved = W.random_walks(many.repartition(7), num_walks=2, walk_length=9, p=0.5, q=2.0, seed=1).collect()
    assert sorted(map(tuple, w)) == sorted(map(tuple, moved))


def test_joined_walks_equal_broadcast_walks(spark, random_edges, monkeypatch):
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]), directed=True)
    options = dict(num_walks=2, walk_length=4, p=2.0, q=0.5, seed=5)
    small = W.random_walks(g, **options)
    monkeypatch.setattr(defaults, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, W.random_walks(g, **options).collect()))


def test_step_frequencies(spark):
    g = G.build_graph(edges(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 5), (1, 2, 1)]))
    w = W.random_walks(g, num_walks=4000, walk_length=3, p=0.25, q=4.0, seed=3).filter("start = 1")
    third = w.filter("path[1] = 0").groupBy(F.element_at("path", 3).alias("n")).count().collect()
    total = sum(r["count"] for r in third)
    want = {1: 4.0, 2: 2.0, 3: 1.25}  # back 1/p, common neighbour, further 5/q
    for r in third:
        assert abs(r["count"] / total - want[r.n] / 7.25) < 0.04


def test_every_edge_has_an_interval(spark):
    g = edges(spark, [(0, 1, 1e14), (0, 2, 1), (0, 3, 1e-9), (4, 5, 2)]).withColumn("graph", F.lit(0))
    x = {(r.src, r.dst): r for r in W.intervals(g).collect()}
    assert set(x) == {(0, 1), (0, 2), (0, 3), (4, 5)} and x[0, 2].lo < x[0, 2].hi
    bins = W.sampling_table(W.intervals(g), W._bins(g)).select("src", "dst").distinct()
    assert bins.count() == 4


@pytest.mark.parametrize("p,q", [(0.01, 100.0), (100.0, 0.01), (100.0, 100.0), (0.01, 0.01)])
def test_every_cut_makes_its_steps(spark, monkeypatch, p, q):
    star = [(0, i, 1) for i in range(1, 6)]
    clique = [(100 + i, 100 + j, 1) for i in range(6) for j in range(i)]
    g = G.build_graph(edges(spark, star + clique))
    cuts = []
    monkeypatch.setattr(W, "_walked", lambda *a, f=W._walked: (cuts.clear(), f(*a))[1])
    monkeypatch.setattr(W, "cut", lambda df, f=W.cut: (cuts.append(1), f(df))[1])
    w = W.random_walks(g, num_walks=1, walk_length=7, p=p, q=q, seed=2).collect()
    assert all(len(r.path) == 7 for r in w) and len(cuts) == 2


def test_hub_walks_meet_few_rows(spark):
    """All walkers come by a hub of 100,000 neighbours, some of which are neighbours of each other; nothing is listed walker by neighbour."""
    leaves = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    pairs = spark.range(1, 10_001, 2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    g = G.build_graph(leaves.unionByName(pairs)).withColumn("graph", F.lit(0))
    placed = W.intervals(g)
    states, rows, index = W.second_order(placed, 0.01)
    assert states.count() == 210_000 and index.count() <= 2 * rows <= 8 * 210_000
    fullest = index.groupBy("src", "dst", "kind", "bin").count().agg(F.max("count")).first()[0]
    assert fullest <= 2 * W.NEIGHBOURS_PER_BIN
    w = W.random_walks(g, num_walks=1, walk_length=3, p=1.0, q=0.01, seed=3)
    third = w.filter("start > 0 and path[1] = 0").select("start", F.element_at("path", 3).alias("n"))
    assert third.count() > 90_000 and third.filter("n = start").count() < 20  # 1 of 9,999,900 by mass


def test_second_order_where_no_other_neighbours_are_left(spark):
    """In a triangle all neighbours are known; a place that rounding puts below the others' mass of zero is no division by it."""
    rows = [(0, s, d, *((0.0, 0.3 + 1e-9) if first else (0.3, 1.0)), 2) for s in range(3) for first, d in zip((True, False), sorted({0, 1, 2} - {s}))]
    placed = spark.createDataFrame(rows, "graph int, src long, dst long, lo double, hi double, deg long")
    states, _, index = W.second_order(placed, 0.5)
    assert {r.far for r in states.collect()} == {0.0} and {r.kind for r in index.collect()} == {W.NEAR}


def test_second_order_walks_with_null_weights_are_not_doubled(spark):
    """Places of null and of real length that are equal have one order, whatever order the rows come in; no two ways of an edge's index hold the same place."""
    rows = [(0, s, d, w) for s in range(6) for d, w in ((k, None if (s + k) % 3 == 0 else 1.0 + k) for k in range(6) if k != s)]
    for order in (F.col("dst"), -F.col("dst"), F.xxhash64("dst")):
        g = spark.createDataFrame(rows, "graph int, src long, dst long, weight double").orderBy(order)
        _, _, index = W.second_order(W.intervals(g).orderBy(order), 0.5)
        other = index.select(*index.columns[:5], F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        assert index.join(other, index.columns[:5]).filter("lo < lo2 AND lo2 < hi").isEmpty()


def test_null_weights_are_never_drawn(spark):
    e = spark.createDataFrame([(0, 1, None), (0, 2, 1.0), (0, 3, 3.0), (0, 4, None)], EDGES)
    drawn = {r.n: r["count"] for r in W.random_walks(e, num_walks=2000, walk_length=2, seed=1).filter("start = 0").groupBy(F.element_at("path", 2).alias("n")).count().collect()}
    assert set(drawn) == {2, 3} and abs(drawn[2] / 2000 - 0.25) < 0.04
    rows = W.rows_of_bins(spark.createDataFrame([(0, 7, 0, i / 200, (i + 1) / 200, i, 1) for i in range(200)], "graph int, src long, bin long, lo double, hi double, dst long, bins long"))
    assert sorted(len(r.nexts) for r in rows.collect()) == [8, 64, 64, 64]


def test_bins_are_runs_of_intervals(spark):
    """The same intervals in the same bins as those of the sampling table, with a hub, an edge over many bins, null weights and ends; the
    intervals, which are sorted by their node, are neither exchanged nor grouped again."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.randrange(12), rnd.randrange(300), rnd.choice([None, 0.0, 1.0, 2.5])) for _ in range(3000)]
    rows += [(0, 50, i, 1e5 if i == 100 else 1.0) for i in range(500)] + [(1, 60, None, 2.0), (1, 60, 5, 1.0), (1, None, 5, 1.0), (1, 70, 5, None)]
    g = spark.createDataFrame(list({r[:3]: r for r in rows}.values()), "graph int, src long, dst long, weight double")
    sizes = W._bins(g)

    def listed(table):
        out = {}
        for r in table.collect():
            assert len(r.ends) <= W.INTERVALS_IN_ROW and r.hi == r.ends[-1] and r.ends == sorted(r.ends)
            out.setdefault((r.graph, r.src, r.bin), []).extend(zip(r.ends, r.nexts, r.sizes))
        return {k: sorted(v, key=str) for k, v in out.items()}

    for hot, edges_ in ((None, g), (100, g.filter("weight IS NOT NULL"))):
        found = W.bins_of_intervals(W.intervals(W._sized(edges_, sizes, "weight"), hot))
        assert listed(found) == listed(W.rows_of_bins(W.sampling_table(W.intervals(edges_), sizes)))
    plan = W.bins_of_intervals(W.intervals(g.withColumn("bins", F.lit(1).cast("long")), None))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_second_order_index_frequencies(spark):
    """Common neighbours and others between them, with unequal weights and a dead end, against the definition."""
    star = [(0, k, 1 + k % 3) for k in range(1, 30)]
    e = star + [(1, k, 2) for k in range(2, 30, 3)] + [(0, 0, 2)]
    g = G.build_graph(edges(spark, e))
    table = {(r.src, r.dst): r.weight for r in g.collect()}
    want = naive_second_order(table, 3.0, 0.2)
    w = W.random_walks(g, num_walks=9000, walk_length=3, p=3.0, q=0.2, seed=6).filter("start = 1 and path[1] = 0")
    third = {r.n: r["count"] for r in w.groupBy(F.element_at("path", 3).alias("n")).count().collect()}
    total = sum(third.values())
    assert total > 600 and set(third) <= {n for s, d, n in want if (s, d) == (1, 0)}
    for (s, d, n), prob in want.items():
        if (s, d) == (1, 0):
            assert abs(third.get(n, 0) / total - prob) < 4 * (prob / total) ** 0.5 + 1e-3


def test_triangles_in_cells(spark, random_edges):
    """Small cells and repeated lists against all triples; directions that are missing stay null."""
    rnd = random.Random(7)
    pairs = {tuple(sorted((rnd.randrange(40), rnd.randrange(40)))) for _ in range(300)}
    pairs = {(a, b): (float(a + 1), None if b % 3 == 0 else float(b)) for a, b in pairs if a < b}
    arcs = spark.createDataFrame([(5, a, b, *w) for (a, b), w in pairs.items()], "graph int, lo long, hi long, out double, back double")
    want = sorted((5, a, b, c, *pairs[a, b], *pairs[a, c], *pairs[b, c]) for a, b in pairs for c in range(b + 1, 40) if (a, c) in pairs and (b, c) in pairs)
    for size in (5, 60, 10_000):
        got = triangles.triangles(arcs, ["graph"], size).collect()
        assert sorted(tuple(r) for r in got) == want
    assert triangles.triangles(arcs.limit(0), ["graph"]).count() == 0


def test_lists_sent_for_triangles_grow_with_the_arcs(spark):
    """Neighbours on a ring: whatever the number of arcs, an arc takes part in the same few rows that are exchanged; none is dealt to more and more cells."""
    def exchanged(n):
        arcs = spark.range(n).select(F.lit(0).alias("graph"), F.col("id").alias("lo"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 3)).alias("hi"))
        arcs = arcs.withColumns({"out": F.lit(1.0), "back": F.lit(1.0)})
        own, sent = triangles.lists(arcs, ["graph"])
        assert triangles.triangles(arcs, ["graph"]).count() == 3 * n - 4
        return own.count() + sent.count()

    assert exchanged(2000) == 2 * exchanged(1000) == 2000 * 3
    hub = spark.range(1, 1001).select(F.lit(0).alias("graph"), F.lit(0).cast("long").alias("lo"), F.col("id").alias("hi"), F.lit(1.0).alias("out"), F.lit(1.0).alias("back"))
    own, sent = triangles.lists(hub, ["graph"], 100)
    assert {r.n for r in own.select(F.size("own").alias("n")).collect()} == {100} and sent.agg(F.max(F.size("sent"))).first()[0] == 100
    assert sent.agg(F.sum(F.size("sent"))).first()[0] == 1000 * 999 // 2


def test_lists_sent_for_triangles_are_ids(spark):
    """Most entries sent close no triangle, so weights, which may be structs, are not sent along with them."""
    arcs = spark.createDataFrame([(0, 1, (0.5, 1.0), None), (0, 2, (1.5, 2.0), (3.0, 4.0)), (1, 2, None, (5.0, 6.0))], "lo long, hi long, out struct<a:double,b:double>, back struct<a:double,b:double>")
    _, sent = triangles.lists(arcs, [])
    assert sent.schema["sent"].dataType.simpleString() == "array<bigint>"
    assert [tuple(r) for r in triangles.triangles(arcs, []).collect()] == [(0, 1, 2, (0.5, 1.0), None, (1.5, 2.0), (3.0, 4.0), None, (5.0, 6.0))]


def test_stored_frames_leave_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = {held.apply(k).getName() for k in range(held.size())}
        return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}

    before = files()
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    found = stored(df.groupBy("v").count().join(df.withColumnRenamed("id", "w").hint("merge"), "v"))
    assert not files() - before
    assert found.count() == 1000 and spark.conf.get(CLEANUP, "false") == "false"


def test_frames_of_edges_are_never_broadcast(spark, random_edges):
    """Their files are small enough here, but a row on the driver takes many times the bytes it has in one."""
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]), directed=True)
    t = G.edge_transitions(g, p=0.5, q=2.0)
    steps = spark.createDataFrame([(1, 2, 3)], "src long, dst long, nbr long")
    for found in (G.closing_edges(g), G.near_neighbours(g), t, G.step_probabilities(g.select("src", "dst"), g, t), G.step_probabilities(steps, g, t)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("directed", [False, True])
def test_all_steps_after_edges(spark, random_edges, directed):
    """Without named neighbours: the probability of every step, and none of them goes through an exchange."""
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]), directed=directed).cache()
    want = naive_second_order({(r.src, r.dst): r.weight for r in g.collect()}, 0.25, 4.0)
    found = G.step_probabilities(g.select("src", "dst"), g, G.edge_transitions(g, 0.25, 4.0))
    got = {(r.src, r.dst, r.nbr): r.prob for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]


def test_exact_draw_frequencies(spark):
    """Steps with strong biases."""
    g = G.build_graph(edges(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 5), (1, 2, 1)]))
    w = W.random_walks(g, num_walks=4000, walk_length=3, p=50.0, q=0.02, seed=3).filter("start = 1 and path[1] = 2")
    third = {r.n: r["count"] for r in w.groupBy(F.element_at("path", 3).alias("n")).count().collect()}
    total = sum(third.values())
    # At 2 after 1: back to 1 with weight 1/50, on to 0 (a neighbour of 1) with weight 2.
    assert abs(third.get(1, 0) / total - 0.02 / 2.02) < 0.02
    w = W.random_walks(g, num_walks=4000, walk_length=3, p=50.0, q=20.0, seed=4).filter("start = 1 and path[1] = 0")
    third = {r.n: r["count"] for r in w.groupBy(F.element_at("path", 3).alias("n")).count().collect()}
    total = sum(third.values())
    want = {1: 0.02, 2: 2.0, 3: 0.25}
    assert all(abs(third.get(n, 0) / total - x / 2.27) < 0.04 for n, x in want.items())


def test_pairs_near_each_other(spark):
    paths = [[1, 2, 3, 2, 5], [4], [1, 1, 2]]
    want = {}
    for p in paths:
        for i in range(len(p)):
            for j in range(len(p)):
                if 0 < abs(i - j) <= 3:
                    want[p[i], p[j]] = want.get((p[i], p[j]), 0) + 4 - abs(i - j)
    walks = spark.createDataFrame([(p,) for p in paths], "path array<long>")
    assert {(r.node, r.other): r.n for r in embedding.node_pairs(walks, 3).collect()} == want


def test_pairs_are_packed_by_node(spark, monkeypatch):
    """Pairs are no rows: what is stored grows with the nodes times the blocks, however many pairs the walks hold."""
    rnd, rows = random.Random(5), []
    walks = spark.createDataFrame([([rnd.randrange(60) for _ in range(80)],) for _ in range(40)], "path array<long>")
    kept = lambda df, *by, f=embedding.stored: (rows.append((x := f(df, *by)).count()), x)[1]
    monkeypatch.setattr(embedding, "stored", kept)
    assert embed_walks(walks, dimensions=4, window_size=10, workers=3).count() == 60
    assert max(rows) <= 60 * 3  # of about 60 * 60 pairs


def test_pairs_in_pieces_and_cells(monkeypatch):
    """The same pairs come from many cells, blocks and pieces, for ids of any size, null ids and null, empty and very short walks."""
    rnd = random.Random(6)
    ids = [None, 0, 1, 2, -5, 2**62, -(2**62), *range(1000, 1008)]
    paths = [[rnd.choice(ids[: rnd.choice((3, 15))]) for _ in range(rnd.randrange(30))] for _ in range(40)] + [None, [], [7]]
    want = {}
    for p in paths:
        p = [embedding.NO_NODE if x is None else x for x in p or []]
        for i, a in enumerate(p):
            for j in range(max(0, i - 4), min(len(p), i + 5)):
                if i != j:
                    want[a, p[j]] = want.get((a, p[j]), 0) + 5 - abs(i - j)
    walks = pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.list_(pa.int64()))})
    for blocks, parts, places in ((1, 1, 1 << 18), (3, 1, 7), (2, 4, 40), (1, 1, 7)):
        monkeypatch.setattr(embedding, "PLACES_AT_ONCE", places)
        sent = pa.Table.from_batches(embedding._sent(4, blocks, parts)(iter([walks, walks.slice(0, 0)])))
        got = {}
        for cell in range(blocks * parts):
            for batch in embedding._counted(4, blocks)(iter(sent.filter(pc.field("cell") == cell).to_batches())):
                for r in batch.to_pylist():
                    others, n = embedding._others(r)
                    assert r["total"] == n.sum() and {r["bucket"]} == set(embedding._blocks(np.array([r["node"]]), blocks))
                    assert {(r["bucket"] + r["turn"]) % blocks} == set(embedding._blocks(others, blocks))
                    got.update({(r["node"], o): got.get((r["node"], o), 0) + k for o, k in zip(others.tolist(), n.tolist())})
        assert got == want


def test_embeddings_put_neighbours_closer(spark):
    ring = [(b + i, b + j, 1) for b in (0, 100) for i in range(20) for j in range(i)]
    g = G.build_graph(edges(spark, ring + [(0, 100, 1)]))
    w = W.random_walks(g, num_walks=10, walk_length=20, seed=1).cache()

    def gap(**options):
        v = {r.node: r.vector for r in embed_walks(w, dimensions=16, window_size=3, seed=1, **options).collect()}
        assert len(v) == 40 and all(len(x) == 16 for x in v.values())

        def cosine(a, b):
            dot = sum(x * y for x, y in zip(v[a], v[b]))
            return dot / (sum(x * x for x in v[a]) * sum(y * y for y in v[b])) ** 0.5

        inside = [cosine(b + i, b + j) for b in (0, 100) for i in range(20) for j in range(i)]
        across = [cosine(a, b) for a in range(20) for b in range(100, 120)]
        return sum(inside) / len(inside) - sum(across) / len(across)

    assert abs(gap(epochs=0)) < 0.3  # nothing is learned without training
    assert gap(epochs=4, workers=1) > 0.7 and gap(epochs=4, workers=3) > 0.4  # in one block and in buckets of three


def test_embeddings_do_not_depend_on_partitions(spark, random_edges):
    g = G.build_graph(edges(spark, [(a, b, w) for (a, b), w in random_edges.items()]))
    w = W.random_walks(g, num_walks=4, walk_length=10, seed=1)
    one, two = ({r.node: r.vector for r in embed_walks(x, dimensions=8, window_size=2, workers=4, block_nodes=3).collect()} for x in (w, w.repartition(5)))
    assert one == two and len(one) > 5 and all(any(x) for x in one.values())
    assert embed_walks(w.limit(0)).count() == 0


def test_pairs_are_stored_as_columns(spark, monkeypatch):
    """The pairs, by far the most rows of an embedding, and the walks are not rows of a checkpoint, which takes several times the disk."""
    checkpoints = []
    monkeypatch.setattr(embedding, "cut", lambda df, f=embedding.cut: (checkpoints.append(set(df.columns)), f(df))[1])
    walks = spark.createDataFrame([([1, 2, 3, 2],), ([4, 1],), (None,)], "path array<long>")
    assert embed_walks(walks, dimensions=4, window_size=2, workers=2).count() == 4
    assert not any({"other", "path"} & columns for columns in checkpoints)


def test_unweighted_pipeline_has_empty_threshold_graphs(spark):
    e = edges(spark, [(1, 2, 9), (2, 3, 9)])
    v = embed_graph(e, EmbeddingConfig(num_walks=2, walk_length=4, dimensions=8, workers=1))
    assert sorted(r.node for r in v.collect()) == [1, 2, 3]
