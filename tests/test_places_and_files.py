import hashlib
import json
from urllib import parse

from pyspark.sql import functions as F

from dwellgraph.functions.text import KEPT, six_decimals
from dwellgraph.operators import places as P
from dwellgraph.operators import spread
from dwellgraph.operators.meetings import meetings
from dwellgraph.sources import lines as L
from dwellgraph.sources import sinks
from helpers import STAY, at, random_stays


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_sources(spark, tmp_path):
    cdr = write(tmp_path, "cdr.csv", "0,20150901080000,1,u1,c1\n0,20150931080000,1,u1,c1\nx,y\n0,20150901080001,1,u2,\n0,20150901080002,1,u2,c2,\n")
    assert [(r.user, r.cid) for r in L.read_cdr(spark, cdr).orderBy("user").collect()] == [("u1", "c1"), ("u2", "c2")]
    users = write(tmp_path, "users.txt", "u1,a\nu1,b\nu2\n")
    assert {r.user for r in L.read_users(spark, users).collect()} == {"u1", "u2"}
    alias = write(tmp_path, "alias.txt", "c1,k1\nc2,k1\n")
    assert L.read_cell_alias(spark, alias).count() == 2
    cells = write(tmp_path, "cells.csv", ",".join(["a", "b", "c", "k1", "e", "f", "g", "name", "i", "j", "k", "l", "110.5", "20.25"]) + "\nshort,line\n")
    assert [tuple(r) for r in L.read_cells(spark, cells).collect()] == [("k1", "name", 110.5, 20.25)]
    near = write(tmp_path, "near.txt", "c1\tc2,c3\nc2\tc1\nc1\tc4\n")
    assert sorted(map(tuple, L.read_adjacency(spark, near).collect())) == [("c1", "c4"), ("c2", "c1")]
    stays = write(tmp_path, "stays.csv", "c1,110.0,20.0,u1,20150901080000,20150901080100,60.0,3\nc1,110.0,20.0,u1,20150901080000,20150901080100,60\n")
    assert [(r.stay_s, r.n_records) for r in L.read_stays(spark, stays).collect()] == [(60, 3)]
    assert [(r.stay_s, r.n_records) for r in L.read_stays(spark, stays, default_count=1).collect()] == [(60, 1)]
    graph = write(tmp_path, "g.edgelist", "1 2 3.5\n# note\n2\t3 1\n1 2 4.5\n\n")
    assert [(r.src, r.dst, r.weight) for r in L.read_edges(spark, graph, weighted=True).orderBy("seq").collect()] == [(1, 2, 3.5), (2, 3, 1.0), (1, 2, 4.5)]
    assert L.read_edges(spark, graph).agg(F.sum("weight")).first()[0] == 3.0
    spots = write(tmp_path, "spots.txt", "110.1234567,20.5,x\n")
    assert P.location_key(L.read_locations(spark, spots)).first().location_key == "20.500000,110.123457"


def test_sinks_round_trip(spark, tmp_path):
    stays = spark.createDataFrame(random_stays(1, users=1, n=5), STAY + ", n_records long")
    path = str(tmp_path / "out")
    sinks.write_trajectories(stays, path, single_file=True)
    back = L.read_stays(spark, path)
    assert back.exceptAll(stays.select(back.columns)).isEmpty() and back.count() == stays.count()
    sinks.write_trajectories(stays, path, fmt="parquet")
    assert spark.read.parquet(path).count() == stays.count()
    v = spark.createDataFrame([(2, [0.5, 1.0]), (1, [0.25, -1.0])], "node long, vector array<float>")
    for single in (True, False):
        sinks.write_embeddings(v, path, single_file=single)
        got = [r.value for r in spark.read.text(path).collect()]
        assert sorted(got) == sorted(["2 2", "1 0.250000 -1.000000", "2 0.500000 1.000000"])


def test_responses(spark, tmp_path):
    poi = dict(tag="t", name="n", direction="e", distance="5")
    doc = {"result": {"addressComponent": {"city": "c", "district": "d"},
                      "pois": [{"uid": "u1", **poi}, {"uid": "u2", **poi}],
                      "poiRegions": [{"uid": "u2", **poi, "name": "other"}, {"uid": "u3", **poi}]}}
    folder = tmp_path / "near"
    folder.mkdir()
    (folder / "20.5,110.1.json").write_text(json.dumps(doc, indent=1))
    out = P.flatten_nearby(L.read_responses(spark, str(folder)))
    rows = [(r.location_key, r.uid, r.name, r.source) for r in out.collect()]
    assert rows == [("20.5,110.1", "u1", "n", "poi"), ("20.5,110.1", "u2", "n", "poi"), ("20.5,110.1", "u3", "n", "region")]
    assert {r.description for r in P.describe_pois(out).collect()} == {"t,n,e,5"} and P.distinct_uids(out).count() == 3
    detail = {"result": {"name": "N", "location": {"lng": 110.1, "lat": 20}, "detail_info": {"tag": "park"}}}
    bad = {"result": {"name": "N", "detail_info": {}}}
    d = spark.createDataFrame([("a", json.dumps(detail)), ("b", json.dumps(bad)), ("c", "not json")], "uid string, value string")
    details = P.flatten_details(d)
    assert [r.value for r in P.detail_lines(details).collect()] == ["a\tN\t110.100000\t20.000000\t\t\tpark\t\t\t\t\t\t\t"]


def test_signatures_match_the_standard_library(spark):
    texts = ["plain", "two words", "a+b*c~d%e", "äöü 中文", "x\"<>[]{}|^`\\", "k=v&y=z/:@!$,;'()#?"]
    df = spark.createDataFrame([(t,) for t in texts], "uid string")
    for r in P.signed_requests(df, P.detail_request("key"), "secret", "http://h").collect():
        request = "/place/v2/detail?uid=%s&output=json&scope=2&ak=key" % r.uid
        sn = hashlib.md5(parse.quote_plus(parse.quote(request, safe=KEPT) + "secret").encode()).hexdigest()
        assert r.sn == sn and r.url == parse.quote("http://h" + request + "&sn=" + sn, safe=KEPT)


def test_radius_search_against_all_pairs(spark):
    import math
    import random

    rnd = random.Random(8)

    def points(n):
        return [(str(i), (rnd.choice([0.001, 359.999, 190.0]) + rnd.uniform(-0.004, 0.004)) % 360 - 180, rnd.choice([0.0, 65.0, -33.0]) + rnd.uniform(-0.004, 0.004))
                for i in range(n)]

    a, b = points(60), points(200)
    cells = spark.createDataFrame(a, "cid string, lon double, lat double")
    pois = spark.createDataFrame(b, "uid string, lon double, lat double")

    def metres(x, y):
        r = [math.radians(v) for v in (x[2], y[2], x[1] - y[1])]
        c = math.sin(r[0]) * math.sin(r[1]) + math.cos(r[0]) * math.cos(r[1]) * math.cos(r[2])
        return round(math.acos(max(-1, min(1, c))) * 6371, 4) * 1000

    want = {(x[0], y[0]) for x in a for y in b if metres(x, y) <= 300}
    for hot in (None, 10):
        got = {(r.cid, r.uid) for r in P.pois_within(cells, pois, 300, hot_rows=hot).collect()}
        assert got == want and want


def test_meetings_against_all_pairs(spark):
    rows = random_stays(6, users=4, n=40, cells=2, pause=(0, 60))
    df = spark.createDataFrame([r[:7] for r in rows], STAY)
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and min(x[5], y[5]) >= max(x[4], y[4]):
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
    for hot in (None, 5):
        assert {(r.src, r.dst): r.weight for r in meetings(df, hot_rows=hot).collect()} == want
    assert at(0).year == 2024 and want


def test_decimals_are_those_of_the_exact_value(spark):
    values = [110.3409155, 0.1234565, 0.0000005, 1.0000025, -0.0000005, 123456.0000005, 0.00390625, -179.1234565, 2.5000005]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r.i: r.s for r in df.select("i", six_decimals("x").alias("s")).collect()}
    assert got == {i: "%.6f" % x for i, x in enumerate(values)}


def test_nulls_stay_fields(spark):
    rows = [("u", "c", None, 2.0, 10, None), ("u", None, 1.5, None, 20, 3)]
    stays = spark.createDataFrame(rows, "user string, cid string, lon double, lat double, stay_s long, n_records long").selectExpr(
        "user", "cid", "lon", "lat", "timestamp'2015-09-01 00:00:00' AS start_ts", "timestamp'2015-09-01 01:00:00' AS end_ts", "stay_s", "n_records")
    back = sorted((r.stay_s, r.lon, r.lat, r.n_records) for r in L.parse_stays(sinks.stay_lines(stays), keep_empty=True).collect())
    assert back == [(10, None, 2.0, None), (20, 1.5, None, 3)]


def test_empty_ends_of_stay_lines(spark):
    text = ["c,1.0,2.0,u,20150901080000,20150901080100,60,3,,", "c,1.0,2.0,u,20150901080000,20150901080100,60,", "c,1.0,2.0,u,20150901080000,20150901080100,60,4"]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    assert sorted(r.n_records for r in L.parse_stays(lines).collect()) == [3, 4]
    assert sorted(str(r.n_records) for r in L.parse_stays(lines, keep_empty=True).collect()) == ["4", "None"]


def test_weights_that_are_no_numbers(spark):
    lines = spark.createDataFrame([(t,) for t in ("1 2 inf", "1 2 -inf", "1 2 nan", "1 2 x", "1 2 7")], "value string")
    assert [r.weight for r in L.parse_edges(lines, weighted=True).collect()] == [7.0]


def test_stored_responses(spark, tmp_path):
    rows = [("a/b 1.2", "{1}"), ("é", "{2}"), ("x", "{3}\n{4}"), ("x", "{3}\n{4}"), (None, "{5}"), ("y", None)]
    folder = str(tmp_path / "responses")
    sinks.write_responses(spark.createDataFrame(rows, "location_key string, value string"), folder)
    assert {(r.location_key, r.value) for r in L.read_responses(spark, folder, encoded=True).collect()} == {("a/b 1.2", "{1}"), ("é", "{2}"), ("x", "{3}\n{4}")}


def test_stored_responses_are_listed_by_tasks(spark, tmp_path):
    """No folder holds all files, and no file is a split of Spark's reader; files beside the subfolders are read too."""
    folder = tmp_path / "many"
    rows = spark.range(3000).select(F.concat(F.lit("k "), F.col("id").cast("string")).alias("location_key"), F.col("id").cast("string").alias("value"))
    sinks.write_responses(rows, str(folder))
    (folder / "own+key.json").write_text("{}")
    assert not [p for p in folder.iterdir() if p.is_file() and p.name != "own+key.json"] and max(len(list(p.iterdir())) for p in folder.iterdir() if p.is_dir()) < 60
    found = L.read_responses(spark, str(folder), encoded=True)
    assert {(r.location_key, r.value) for r in found.collect()} == {(f"k {i}", str(i)) for i in range(3000)} | {("own key", "{}")}
    assert "Scan text" not in found._jdf.queryExecution().executedPlan().toString()


def test_tree_nodes_cover_each_bucket_once(spark):
    from dwellgraph.operators.meetings import covering

    spans = [(a, b) for a in (-7, 0, 5, 1000) for b in range(a, a + 70, 3)] + [(3, 3 + 8760)]
    df = spark.createDataFrame(spans, "a long, b long").select("a", "b", covering(F.col("a"), F.col("b")).alias("nodes"))
    for r in df.collect():
        buckets = sorted(k for n in r.nodes for k in range(n.node << n.level, (n.node + 1) << n.level))
        assert buckets == list(range(r.a, r.b + 1))
        assert len(r.nodes) <= 2 * (r.b - r.a + 1).bit_length()  # by the logarithm of the length


def test_meetings_of_long_stays_and_gaps(spark):
    rows = [(f"u{k}", "c", 110.0, 20.0, at(977 * k), at(977 * k + d), d) for k, d in enumerate([10, 40_000_000, 0, 90_000, 3600, 5, 7200, 86_400 * 200])]
    df = spark.createDataFrame(rows, STAY)
    for gap in (0, 1500):
        want = {(x[0], y[0]): 1 for x in rows for y in rows if x[0] < y[0] and (y[4] - x[5]).total_seconds() <= gap}
        for hot in (None, 2):
            assert {(r.src, r.dst): r.weight for r in meetings(df, max_gap_s=gap, hot_rows=hot).collect()} == want
    assert meetings(df.limit(0)).count() == 0


def test_meetings_counted_by_blocks_of_users(spark, monkeypatch):
    """Many stays near each other are counted by pairs of blocks of users, without a join or a count of rows; small blocks and parts, equal starts, nulls."""
    from dwellgraph.operators import meetings as M

    rows = random_stays(6, users=9, n=30, cells=2, pause=(0, 60))
    rows += [(f"u{k}", "0", 110.0, 20.0, at(5), at(5 + k), k, 1) for k in range(9)] + [("é", "1", 110.0, 20.0, at(0), at(900), 900, 1), ("z", "1", 110.0, 20.0, at(9), at(3), -6, 1)]
    lost = [(None, "0", 110.0, 20.0, at(0), at(9), 9), ("u1", None, 110.0, 20.0, at(0), at(9), 9), ("u2", "0", 110.0, 20.0, at(0), None, 9)]
    df = spark.createDataFrame([r[:7] for r in rows] + lost, STAY)
    monkeypatch.setattr(M, "PAIRS_FOR_A_ROW", 0)
    monkeypatch.setattr(M, "PAIRS_AT_ONCE", 16)
    for least, gap, users, hot in ((0, 0, 3, None), (3, 0, 3, 1000), (0, 70, 5, None), (0, 70, 100, None), (0, 0, 1, 3)):
        monkeypatch.setattr(M, "BLOCK_USERS", users)
        want = {}
        for x in rows:
            for y in rows:
                a, b = sorted((x, y), key=lambda r: (r[4], r[0]))
                near = (b[4] - a[5]).total_seconds() <= gap if gap else (min(x[5], y[5]) - max(x[4], y[4])).total_seconds() >= least
                if x[0] < y[0] and x[1] == y[1] and near and x[6] >= 0 and y[6] >= 0:
                    want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
        found = meetings(df, min_overlap_s=least, max_gap_s=gap, hot_rows=hot)
        assert {(r.src, r.dst): r.weight for r in found.collect()} == want and found.count() == len(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (hot == 3)  # blocks too large for a task: the join


def test_tasks_of_a_join_grow_with_its_pairs(spark, monkeypatch):
    """Rows that are few in bytes but make many pairs are not put into a task or two."""
    many = spark.range(2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    few = spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("b"))
    want = sorted((a % 50, a, b) for a in range(2000) for b in range(500) if a % 50 == b % 50)
    monkeypatch.setattr(spread, "PAIRS_PER_TASK", 500)
    for hot_rows in (1_000_000, 5):  # without and with hot keys
        joined = spread.spread_join(many, few, ["k"], hot_rows=hot_rows)
        assert sorted(map(tuple, joined.collect())) == want
        assert joined.rdd.getNumPartitions() >= 40
