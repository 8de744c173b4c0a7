"""Merkle manifests, repaired conversations and mixed sources against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from dwellgraph.llm import merkle, mixing, queries, turns
from dwellgraph.operators import ranks
from pyspark.sql import functions as F, types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Manifest


def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def grown(nodes):
    """Root, and for each node the (left, right) steps up to it, level by level over the whole list."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            steps[k].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
            at[k] = place // 8
        nodes = [sha("".join(nodes[a : a + 8])) for a in range(0, len(nodes), 8)]
    return nodes[0], steps


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[g] = grown([leaf(r, r.text) for r in groups[g]])
    root, above = grown([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, above):
        for r, own in zip(groups[g], trees[g][1]):
            steps = own + upper
            changed = r.text is not None and zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 0
            node = leaf(r, r.text.translate(LOWER) if changed else r.text)
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r.doc_id, leaf(r, r.text), trees[g][0], root, sha("".join(a + b for a, b in steps)), node, node == root))
    return Counter(out)


def manifest_query(spark, rows, folder):
    rows.write.parquet(f"{folder}/documents.parquet")
    return Counter(tuple(r) for r in queries.op11_merkle_manifest(spark, str(folder)).collect())


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_like_brute_force(spark, documents, odd_rows, tmp_path, monkeypatch, height):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (height,))  # small blocks: block roots are appended on several levels
    r = random.Random(height)
    rows = [(k, f"Text {k} É" * r.randint(0, 3), r.choice(["en"] * 8 + ["de", "É", None, f"l{k % 11}"])) for k in range(700)] + [(k, "lone", f"only{k}") for k in range(900, 903)]
    docs = documents(rows + odd_rows).repartition(7)
    got = manifest_query(spark, docs, tmp_path)
    assert got == brute_manifest(docs.collect())
    assert {v[-1] for v in got} == {True, False}


def test_manifest_of_odd_tables(spark, documents, tmp_path):
    assert not manifest_query(spark, documents([]), tmp_path / "none")
    one = documents([(3, None)])
    got = manifest_query(spark, one, tmp_path / "one")
    [(values, _)] = got.items()
    assert got == brute_manifest(one.collect()) and values[1] == values[2] == values[3] and values[4] == sha("")
    clash = one.select("doc_id", "lang", F.lit("x").alias("_rank"), F.lit(1).alias("_block"), F.lit("r").alias("root"), F.lit("ab").alias("leaf"))
    row = merkle.manifest(clash, "lang", ["doc_id"], "leaf").first()
    assert (row["_rank"], row["_block"], row["root"], row["witness"]) == ("x", 1, "ab", [])


def test_open_runs_grow_step_by_step():
    nodes = [sha(str(k)) for k in range(70)]
    for n in (1, 2, 7, 8, 9, 64, 65, 70):
        tree = merkle.OpenRuns()
        for k, node in enumerate(nodes[:n]):
            tree.append(node)
            assert len(tree.witnesses[0]) == sum((k + 1) // 8**j > 0 for j in (1, 2, 3))  # as many steps as complete runs above the first leaf
        assert (tree.close(None), tree.witnesses) == grown(nodes[:n])


def test_ranks_split_a_hot_group(spark):
    rows = [("a", k) for k in range(500)] + [("b", 1), ("c", 5), ("c", 5)]
    df = ranks.ranked(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "g string, v long"), "g", ["v"])
    got = sorted((r.g, r.v, r["_rank"], r["_n"]) for r in df.collect())
    assert got == [("a", k, k, 500) for k in range(500)] + [("b", 1, 0, 1), ("c", 5, 0, 2), ("c", 5, 1, 2)]


def test_blocks_in_parts():
    batches = [pa.record_batch({"_group": ["a"] * n, "_block": pa.array([b] * n, pa.int64())}) for n, b in ((5, 0), (9, 0), (2, 1), (4, 1))]
    assert [t.num_rows for t in merkle.blocks_of(iter(batches))] == [14, 6]
    assert [t.num_rows for t in merkle.blocks_of(iter(batches), 4)] == [4, 4, 4, 2, 4, 2]


# Conversations

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])
GRAMMAR = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faulty(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, edits, repaired turns) over all sequences of edits with two insertions between rows at most."""
    best = None
    gap = ["", "u", "a", "ua", "au", "uu", "aa"]
    choices = [[("D", 4, None)] + ([] if f in ("blank", "duplicate") else
               [("K", 3 * (f == "truncated"), (r, t))] + [("R", 3 + 3 * (f == "truncated"), (x, t)) for x in ("user", "assistant")]) for _, r, t, f in rows]
    for edits in itertools.product(*choices):
        cost = sum(e[1] for e in edits)
        if best and cost > best[0]:
            continue
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            line, audit = [], ""
            for k, more in enumerate(gaps):
                line += [("user" if x == "u" else "assistant", "") for x in more]
                audit += "I" * len(more)
                if k < len(edits):
                    audit += edits[k][0]
                    line += [edits[k][2]] if edits[k][2] else []
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in line)):
                best = min(best or (total, audit, line), (total, audit, line))
    return best


def brute_repair(given):
    rows = defaultdict(list)
    for r in damage(given):
        rows[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in given}:
        own = faulty(rows[conv])
        found = [t for t, *_ in own if t is not None]
        cost, audit, line = cheapest(own)
        count = Counter(f for *_, f in own)
        roles = [r[:1] for _, r, _, _ in own]
        out[conv] = (
            max(found) - min(found) + 1 - len(set(found)) if found else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit, sha("\n".join(f"{r}:{t}" for r, t in line)),
        )
    return out


def repair_query(spark, rows, folder):
    spark.createDataFrame(rows, CONVERSATIONS).withColumn("position", F.lit("x")).write.parquet(f"{folder}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(folder)).collect()
    found = {r[0]: tuple(r[1:]) for r in got}
    assert len(found) == len(got)
    return found


def made_conversations(seed, n, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        length = r.randint(1, longest)
        for turn in range(length):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "Assistant", "usr"]) if r.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = r.choice(["Yes.", "No!", "and so", "Why? \n", "é。", "", " \t", None, "Yes."])
            rows.append((conv, r.choice([turn] * 9 + [None, turn + 2]), role, text))
    return rows


def test_repair_like_brute_force(spark, tmp_path):
    rows = made_conversations(4, 260, 4) + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ok."), (7000, 3, "user", "A."), (7000, 3, "user", "A."), (7000, 3, "user", "A.")]
    got = repair_query(spark, rows, tmp_path)
    wanted = brute_repair(rows)
    assert {k: (got[k], v) for k, v in wanted.items() if got[k] != v} == {}
    assert {e for v in got.values() for e in v[-2]} == set("DIKR")


def test_repair_of_odd_tables(spark, tmp_path):
    assert repair_query(spark, [], tmp_path / "none") == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    kept = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    long_text = "word " * 200_000 + "."
    got = repair_query(spark, [(gone, 0, "user", "Hi."), (kept, 0, "system", long_text)], tmp_path / "few")
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[kept] == (0, 0, 0, 0, 0, 4, "D", sha(""))


def test_repair_across_batches(spark):
    """A long conversation in many small batches, against dynamic programming over whole strings."""
    r = random.Random(8)
    rows = [(1, k, r.choice(["user", "assistant", "system", "x"]), r.choice(["A.", "b", f"c{k}.", f"d{k}!", ""])) for k in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, CONVERSATIONS)
        [got] = turns.audited(df, df).collect()
        edited = turns.repaired(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = {"": (0, "")}  # by the roles so far, as far as they matter
    state = {"s": "s", "u": "u", "a": "a"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insertions(costs):
        for _ in range(2):
            for s, (c, a) in list(costs.items()):
                costs[after[s]] = min(costs.get(after[s], (c + 4, "")), (c + 3, a + "I"))
        return costs

    for _, role, text, fault in faulty(rows):
        new = {}
        for s, (c, a) in insertions(dict(plain)).items():
            ways = [(s, 4, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                ways.append((after[s], 3 + extra, "R"))
                if role[:1] == after[s] or role[:1] == "s" and s == "":
                    ways.append((state[role[:1]], extra, "K"))
            for to, cost, edit in ways:
                new[to] = min(new.get(to, (c + cost, a + edit)), (c + cost, a + edit))
        plain = new
    ends = insertions(dict(plain))
    assert (got.cost, got.audit) == min(ends[s] for s in ("", "a") if s in ends)
    assert [e.position for e in edited] == list(range(len(edited))) and "".join(e.edit for e in edited) == got.audit
    assert GRAMMAR.fullmatch("".join(e.role[0] for e in edited if e.edit != "D"))
    assert sum(e.cost for e in edited) == got.cost


# Mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, over, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while over > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            out[s] += over * w[s] / total
        over = sum(max(0.0, out[s] - 2 * sizes[s]) for s in order)
        full = {s for s in open_ if out[s] >= 2 * sizes[s]}
        for s in full:
            out[s] = 2.0 * sizes[s]
        open_ -= full
    return out


def corpus(seed, sizes):
    r = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            words = r.choice([0, 1, r.randint(2, 60), r.randint(2, 60), r.randint(100, 900)])
            rows.append((len(rows), " \n".join(["w"] * words) + " ", "en", source))
    return rows


def sourced(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def check_mix(got, rows, nearness):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[3]] += size[r[0]]
    wanted = reshared(by_source)
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(size)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]])
        assert r.target == pytest.approx(wanted[source[r.doc_id]])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= nearness, (s, taken[s], target)


def test_mix_comes_near_its_targets(spark):
    rows = corpus(2, {"a": 1500, "b": 40, "c": 700, "d": 300, "é": 25, None: 400})
    df = sourced(spark, rows)
    got = mixing.mixed(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    check_mix(got, rows, 1)
    again = mixing.mixed(df.repartition(5)).select("doc_id", "taken").collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_mix_of_odd_tables(spark, odd_rows):
    assert mixing.mixed(sourced(spark, [])).count() == 0
    rows = [(a, b, None, None) for a, b in odd_rows]
    got = mixing.mixed(sourced(spark, rows).withColumn("_p", F.lit(1))).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == pytest.approx(got[0].target, abs=got[0].target * 0.4)
    empty = mixing.mixed(sourced(spark, [(1, None, None, "a"), (2, "", None, "b")])).collect()
    assert {(r["size"], r.target, r.taken) for r in empty} == {(0, 0.0, 0)}
    same = mixing.mixed(sourced(spark, [(1, "a b c", None, "a")] * 3000 + [(2, "x", None, "b")] * 9000)).collect()
    assert len(same) == 12000 and abs(sum(r.taken for r in same if r.doc_id == 1) - same[0].target * (same[0].doc_id == 1) - same[-1].target * (same[-1].doc_id == 1)) < 20000


def test_flight_keeps_its_constraints_and_probabilities():
    r = np.random.default_rng(5)
    size = np.sort(r.integers(0, 900, 80).astype(float))[::-1]
    p = r.uniform(0.02, 0.98, 80)
    A = np.vstack([size, np.ones(80)])
    runs = np.array([mixing.flight(p, A, np.random.default_rng(k)) for k in range(600)])
    assert np.abs(runs @ A.T - A @ p).max() < 1e-6
    assert ((runs > 0) & (runs < 1)).sum(axis=1).max() <= 2
    assert np.abs(runs.mean(axis=0) - p).max() < 0.1  # 5 standard deviations of a mean of 600


def test_landing_takes_the_nearest_of_all_ways():
    r = np.random.default_rng(6)
    for _ in range(20):
        size, p = r.integers(1, 50, 7).astype(float), r.uniform(0.1, 0.9, 7)
        off = abs(mixing.landing(p, size) @ size - p @ size)
        assert off == pytest.approx(min(abs(np.array(w) @ size - p @ size) for w in itertools.product((0, 1), repeat=7)))
