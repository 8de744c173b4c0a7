import pytest
from pyspark.sql import functions as F

from dwellgraph.operators import drift, pingpong, regions
from dwellgraph.operators import stays as S
from dwellgraph.plans.cleaning import CleaningConfig, clean_traces
from dwellgraph.session import cut
from helpers import STAY, at, by_user, naive_drift, naive_regions, pieces, random_stays, seconds, stays

NEAR = {"A": 0, "B": 1, "C": 2, "D": 3, "E": 3.5, "X": 50, "Y": 100, "Z": 200}


def records(spark, rows, user="u"):
    data = [(user, at(t), c, 110.0, 20.0) for c, t in rows]
    return spark.createDataFrame(data, "user string, ts timestamp, cid string, lon double, lat double")


def spans(df):
    return sorted(seconds(df, "cid", "start_ts", "end_ts"), key=lambda r: r[1:])


def test_stay_runs_golden(spark):
    r = records(spark, [("A", 0), ("A", 1000), ("A", 3000), ("B", 3100), ("B", 3200)])
    assert spans(S.stay_runs(r)) == [("A", 0, 1000), ("A", 3000, 3000)]
    assert spans(S.stay_runs(r, keep_last=True)) == [("A", 0, 1000), ("A", 3000, 3000), ("B", 3100, 3200)]
    assert S.stay_runs(records(spark, [("A", 0)])).count() == 0


@pytest.mark.parametrize("rows, want", [
    ([("A", 0, 20), ("X", 30, 40), ("A", 50, 60)], "AA"),                      # bounce
    ([("A", 0, 20), ("B", 30, 40), ("X", 50, 55)], "AB"),                      # too fast a tail
    ([("A", 0, 20), ("B", 30, 40), ("X", 1900, 1955)], "ABX"),                 # another segment
    ([("A", 0, 20), ("B", 30, 40), ("X", 1200, 1205)], "ABX"),                 # slow enough a tail
    ([("X", 0, 0), ("Y", 5, 5), ("Z", 400, 900)], "Z"),                        # short cluster
    ([("A", 0, 20), ("X", 30, 40)], "AX"),                                     # two stays pass
    ([("A", 0, 100), ("X", 200, 210), ("X1", 220, 400)], "AXX1"),              # cluster cut
])
def test_drift_golden(spark, rows, want):
    df = stays(spark, rows, {**NEAR, "X1": 51})
    assert "".join(r[0] for r in spans(drift.remove_drift(df, hot_rows=None))) == want


def test_drift_adjacency_is_directional(spark):
    df = stays(spark, [("A", 0, 0), ("X", 5, 5), ("B", 8, 8)], NEAR)
    later_first = spark.createDataFrame([("X", "A"), ("B", "X")], "cid string, nbr_cid string")
    earlier_first = spark.createDataFrame([("A", "X"), ("X", "B")], "cid string, nbr_cid string")
    assert drift.remove_drift(df, later_first, hot_rows=None).count() == 3
    assert drift.remove_drift(df, earlier_first, hot_rows=None).count() < 3


def test_drift_against_definition(spark):
    rows = random_stays(5, users=6, n=80)
    df = spark.createDataFrame([r[:7] for r in rows], STAY)
    adjacent = {("3", "0"), ("1", "4")}
    listed = spark.createDataFrame(list(adjacent), "cid string, nbr_cid string")
    want = sorted(
        (r[0], r[1], r[4].timestamp(), r[5].timestamp())
        for own in by_user(rows).values() for seg in pieces(own, 1200) for r in naive_drift(seg, adjacent)
    )
    out = drift.remove_drift(df, listed)
    got = sorted(tuple(r) for r in out.select("user", "cid", F.unix_timestamp("start_ts").cast("double"),
                                              F.unix_timestamp("end_ts").cast("double")).collect())
    assert got == want and len(got) < len(rows)
    hot = drift.remove_drift(df, listed, hot_rows=100)  # the first user has 240 rows
    assert hot.exceptAll(out).isEmpty() and out.exceptAll(hot).isEmpty()


def test_pingpong_golden(spark):
    df = stays(spark, [("A", 0, 10), ("B", 20, 30), ("A", 40, 50)], NEAR)
    assert spans(pingpong.collapse_pingpong(df)) == [("A", 0, 50)]
    assert [round(r.score, 3) for r in pingpong.station_scores(df).orderBy("cid").collect()] == [2.0, 1.0]
    plain = stays(spark, [("A", 0, 10), ("B", 20, 30), ("C", 40, 50)], NEAR)
    assert spans(pingpong.collapse_pingpong(plain)) == [("A", 0, 10), ("B", 20, 30), ("C", 40, 50)]
    one_cell = stays(spark, [("A", 0, 10), ("A", 20, 30)], NEAR)
    assert spans(pingpong.collapse_pingpong(one_cell)) == [("A", 0, 30)]
    alone = stays(spark, [("A", 0, 10)], NEAR)
    assert pingpong.collapse_pingpong(alone).count() == 0
    assert pingpong.collapse_pingpong(alone, compat=False).count() == 1


def test_merge_golden(spark):
    df = stays(spark, [("A", 0, 10), ("A", 20, 30), ("B", 40, 50), ("B", 60, 70)], NEAR)
    assert seconds(S.merge_stays(df), "cid", "start_ts", "end_ts", "n_records") == [("A", 0, 30, 2), ("B", 40, 70, 1)]
    assert seconds(S.merge_stays(df, exact_count=True), "cid", "n_records") == [("A", 2), ("B", 2)]
    lone = stays(spark, [("A", 0, 10), ("A", 20, 30), ("B", 40, 50)], NEAR)
    assert seconds(S.merge_stays(lone), "cid", "n_records") == [("A", 2), ("B", 1)]


@pytest.mark.parametrize("start, want", [(10811, 3), (10810, 2)])
def test_merge_gap_is_strict(spark, start, want):
    df = stays(spark, [("A", 0, 10), ("A", start, 10900), ("B", 11000, 11010)], NEAR)
    assert S.merge_stays(df).count() == want


def test_residence_golden(spark):
    places = {"A": 0, "A1": 0.1, "C": 5, "D": 10}
    df = stays(spark, [("A", 0, 100), ("A1", 200, 4000), ("C", 4100, 4200), ("D", 4300, 9000)], places)
    got = S.residence_points(df).orderBy("start_ts").select("residence_id").collect()
    assert [r[0] for r in got] == [1, 1, -1, 2]


def test_regions_golden(spark):
    rows = [(c, 100 * i, 100 * i + 50) for i, c in enumerate("ABACBDE")]
    r = regions.merge_regions(stays(spark, rows, NEAR, counts=True)).orderBy("start_ts").collect()
    assert [(c.cid, c.n) for c in r[0].cells] == [("A", 2), ("B", 2), ("C", 1)]
    assert [x.is_region for x in r] == [True, False, False] and r[0].stay_s == 450
    plain = stays(spark, [(c, 100 * i, 100 * i + 50) for i, c in enumerate("ABCD")], NEAR, counts=True)
    assert regions.merge_regions(plain).filter("is_region").isEmpty()
    text = regions.region_lines(regions.merge_regions(stays(spark, rows, NEAR, counts=True)))
    assert any(line.value.startswith("A\tB\tC,110.0\t110.0\t110.0,") and line.value.endswith(",450,2\t2\t1") for line in text.collect())


@pytest.mark.parametrize("cells, seed", [(2, 1), (3, 2), (6, 3), (12, 4)])
def test_regions_against_definition(spark, cells, seed):
    rows = random_stays(seed, users=3, n=70, cells=cells, pause=(0, 4500), far=())
    df = spark.createDataFrame(rows, STAY + ", n_records long")
    want = []
    for user, own in by_user(rows).items():
        for seg in pieces(own, 3600):
            for b, e, joined in naive_regions(seg):
                counts = {}
                for r in seg[b:e + 1]:
                    counts[r[1]] = counts.get(r[1], 0) + r[7]
                want.append((user, seg[b][4].timestamp(), seg[e][5].timestamp(), joined, tuple(counts.items())))

    def rows_of(out):
        return sorted((r.user, r.s, r.e, r.is_region, tuple((c.cid, c.n) for c in r.cells)) for r in out.select(
            "user", F.unix_timestamp("start_ts").cast("double").alias("s"), F.unix_timestamp("end_ts").cast("double").alias("e"),
            "is_region", "cells").collect())

    assert rows_of(regions.merge_regions(df)) == sorted(want)
    # The first user is hot: its segments, and regions that run for long, lie in many slices.
    assert rows_of(regions.merge_regions(df, hot_rows=80)) == sorted(want)
    total = regions.region_cells(regions.merge_regions(df)).agg(F.sum("n")).first()[0]
    assert total == sum(r[7] for r in rows)


def test_one_region_through_many_slices(spark):
    rows = [("u", "AB"[i % 2], 110.0, 20.0, at(10 * i), at(10 * i + 5), 5, 1) for i in range(300)]
    df = spark.createDataFrame(rows, STAY + ", n_records long")
    out = regions.merge_regions(df, hot_rows=20).collect()
    assert len(out) == 1 and [(c.cid, c.n) for c in out[0].cells] == [("A", 150), ("B", 150)]


def test_pipeline_does_not_depend_on_slices_or_partitions(spark):
    rows = random_stays(9, users=3, n=150, pause=(0, 3000))
    cdr = spark.createDataFrame([(r[0], r[4], r[1]) for r in rows], "user string, ts timestamp, cid string")
    cells = spark.createDataFrame(sorted({(r[1], r[2], r[3]) for r in rows}), "cid string, lon double, lat double")
    alias = cells.select("cid", F.col("cid").alias("canon_cid"))
    users = cdr.select("user").distinct()
    options = dict(min_records=20, min_stays=10, stay_gap_s=600)
    whole = clean_traces(cdr, users, alias, cells, None, CleaningConfig(**options))
    sliced = clean_traces(cdr, users, alias, cells, None, CleaningConfig(hot_rows=160, **options))
    assert whole.count() > 50
    assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()
    one = clean_traces(cdr.coalesce(1), users, alias, cells, None, CleaningConfig(hot_rows=None, **options))
    assert one.exceptAll(whole).isEmpty() and whole.exceptAll(one).isEmpty()


def test_reckoned_sizes_do_not_multiply_through_checkpoints(spark):
    df = spark.createDataFrame(spark.sparkContext.parallelize([(k, 1.0) for k in range(20)]), "id long, v double")
    for _ in range(5):
        df = cut(df.join(df.withColumnRenamed("v", "w").hint("merge"), "id").select("id", (F.col("v") + F.col("w")).alias("v")))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert {r.v for r in df.collect()} == {32.0} and df.count() == 20


def test_ordered_steps_in_slices(spark):
    rows = random_stays(11, users=3, n=50, pause=(0, 4000))
    df = spark.createDataFrame([r[:7] for r in rows], STAY)
    for step in (
        lambda hot: S.merge_stays(df, 2000, hot_rows=hot),
        lambda hot: S.residence_points(df, min_stay_s=100, hot_rows=hot),
        lambda hot: S.segment(df, 900, hot_rows=hot),
        lambda hot: pingpong.collapse_pingpong(df, hot_rows=hot),
        lambda hot: S.min_rows(df, 60, order=S.STAY_ORDER, hot_rows=hot),
        lambda hot: pingpong.station_scores(df, hot_rows=hot).withColumn("score", F.round("score", 6)).select(
            "user", "group_id", "cid", "freq", "score"),
        lambda hot: drift.remove_drift(df, true_share=True, hot_rows=hot),
    ):
        whole, sliced = step(None), step(70)
        assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()


def test_properties(spark):
    rows = random_stays(3, users=3, n=80)
    df = spark.createDataFrame([r[:7] for r in rows], STAY)
    n = df.count()
    assert drift.remove_drift(df).exceptAll(df).isEmpty()
    assert pingpong.collapse_pingpong(df).count() <= n and S.merge_stays(df).count() <= n


def test_one_exchange_for_the_trajectory_chain(spark):
    df = spark.createDataFrame([r[:7] for r in random_stays(3)], STAY)
    plan = drift.remove_drift(df, hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_neighbours_come_with_the_cells(spark):
    """With broadcasts off, the stays leave their users for no neighbour lookup: one exchange of the records by user, behind those of the lookups."""
    df = spark.createDataFrame([r[:7] for r in random_stays(3)], STAY)
    cdr = df.select("user", F.col("start_ts").alias("ts"), "cid")
    cells = df.select("cid", "lon", "lat").dropDuplicates(["cid"])
    listed = spark.createDataFrame([("3", "0"), ("1", "4")], "cid string, nbr_cid string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = clean_traces(cdr, None, None, cells, listed, CleaningConfig(hot_rows=None, min_records=1, min_stays=1))
        plan = out._jdf.queryExecution().executedPlan().toString()
        small = drift.remove_drift(df, listed, hot_rows=None)
        want = small.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(user") == 1 and "Python" not in plan
    assert want == drift.remove_drift(df, listed, hot_rows=60).count() > drift.remove_drift(df).count()


def test_scores_of_many_cells_against_definition(spark):
    """A group of 60 cells, two of which have several positions, in both ways, with ties that the first stay decides."""
    import math
    import random

    from dwellgraph.functions.geo import PI_RAW, RADIUS_RAW_KM

    rnd = random.Random(3)
    place = {str(c): [(110 + rnd.random(), 20 + rnd.random()) for _ in range(3 if c < 2 else 1)] for c in range(60)}
    rows = []
    for k in range(200):
        c = str(rnd.randrange(60))
        lon, lat = rnd.choice(place[c])
        rows.append(("u", c, lon, lat, at(10 * k), at(10 * k + 5), 5))
    rows += [("v", c, 110.0 + (c == "B"), 20.0, at(10 * k), at(10 * k + 5), 5) for k, c in enumerate("ABABAB")]

    def km(a, b):
        if a == b:
            return 0.0
        (x, u), (y, v) = [(p[0] * PI_RAW / 180, p[1] * PI_RAW / 180) for p in (a, b)]
        return RADIUS_RAW_KM * math.acos(max(-1, min(1, math.cos(u) * math.cos(x) * math.cos(v) * math.cos(y)
                                                     + math.cos(u) * math.sin(x) * math.cos(v) * math.sin(y) + math.sin(u) * math.sin(v))))

    want, best = {}, {}
    for user in "uv":
        own = [r for r in rows if r[0] == user]
        for c in {r[1] for r in own}:
            first = next(r for r in own if r[1] == c)
            far = [km(first[2:4], r[2:4]) for r in own if r[1] != c]
            want[user, c] = round(sum(r[1] == c for r in own) / (sum(far) / len(far)), 7)
        order = {r[1]: -k for k, r in reversed(list(enumerate(own)))}
        best[user] = max((v, order[c], c) for (u, c), v in want.items() if u == user)[2]
    df = spark.createDataFrame(rows, STAY)
    for hot in (None, 50):
        got = {(r.user, r.cid): round(r.score, 7) for r in pingpong.station_scores(df, hot_rows=hot).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        assert {r.user: r.cid for r in pingpong.collapse_pingpong(df, hot_rows=hot).collect()} == best
    assert best["v"] == "A"


def test_a_hot_null_user_is_split(spark):
    rows = [(None, *r[1:]) if r[0] == "u0" else r for r in random_stays(12, users=3, n=50, pause=(0, 4000))]
    df = spark.createDataFrame([r[:7] for r in rows], STAY)
    from dwellgraph.operators import ordered

    cold, hot = ordered.split_hot(df, ["user"], S.STAY_ORDER, 70)
    assert cold.filter("user is null").count() == 0 and hot.select("_slice").distinct().count() > 1 and hot.filter("user is not null").count() == 0
    for step in (lambda h: S.merge_stays(df, 2000, hot_rows=h), lambda h: S.segment(df, 900, hot_rows=h), lambda h: drift.remove_drift(df, hot_rows=h)):
        whole, sliced = step(None), step(70)
        assert whole.exceptAll(sliced).isEmpty() and sliced.exceptAll(whole).isEmpty()
