"""Operators on whole corpora against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from dwellgraph.llm import components, decontam, minhash, sanitize, urlfilter
from pyspark.sql import functions as F


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_groups(rows):
    """component of each (id, text), by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n, length, edits):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [r.choice(words) for _ in range(length)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(length)] = r.choice(words)
        out.append(" ".join(copy))
    return out


def test_near_duplicates_like_brute_force(documents, monkeypatch):
    texts = near_copies(1, 60, 80, 4) + near_copies(2, 30, 300, 12) + near_copies(3, 20, 12, 1) + ["a b", "a b", "A B", "a", "", None, "x y z u v", "x y z u v w"]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    wanted = brute_groups(rows)
    for size in (150_000, 2_000):  # the second deals clusters out in blocks
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", size)
        got = {r.doc_id: r for r in minhash.near_duplicates(documents(rows)).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
        assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_blocks_are_bounded_by_members(spark, documents, monkeypatch):
    members = spark.range(6000).select(F.lit(1).cast("long").alias("cluster"), F.col("id").alias("node"), F.array("id", F.lit(-1).cast("long")).alias("set"))
    tasks = minhash.dealt(members).groupBy("cluster", "b1", "p1", "b2", "p2").count().collect()
    assert len(tasks) == 6 and max(t["count"] for t in tasks) < 4500  # two blocks of about 2,000
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 5)
    rows = list(enumerate(near_copies(3, 20, 12, 1) + near_copies(1, 40, 80, 4)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == brute_groups(rows)


def test_near_duplicate_odd_rows(documents, odd_rows):
    got = minhash.near_duplicates(documents(odd_rows).withColumn("component_id", F.lit("x"))).collect()
    assert len(got) == len(odd_rows)
    assert {(r.doc_id, r.n_shingles) for r in got if r.doc_id in (1, 2, 3, 5)} == {(1, 0), (2, 0), (3, 0), (5, 1)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(documents([])).count() == 0


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(3)
    both, one, two = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
    s = minhash.sketches([a, b, a[:1], a[:7]])
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert (minhash.sketches([a])[0] == s[0]).all()


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(2000, 2000 + k) for k in range(1, 90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(documents, spark):
    r = random.Random(6)
    words = [f"term{k}" for k in range(500)] + ["the", "of", "and"] * 60
    line = lambda n: [r.choice(words) for _ in range(n)]
    items = [line(30) for _ in range(12)]
    rows, planted = [], set()
    for k in range(150):
        text = line(r.randint(20, 300))
        if k % 10 == 0:
            item = list(items[k // 10 % 12])
            for _ in range(r.choice((0, 2, 4))):  # an edited copy
                item[r.randrange(30)] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = item
            planted.add((k, k // 10 % 12))
        rows.append((k, ", ".join(text).upper() if k % 20 == 0 else " ".join(text)))
    rows += [(900 + k, " ".join(items[3])) for k in range(40)]  # one item leaks into many documents
    planted |= {(900 + k, 3) for k in range(40)}
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(77, None), (78, "too short"), (None, "")], "item_id long, text string")
    got = decontam.contaminated(documents(rows + [(None, None), (5000, "")]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == planted and all(0.5 <= r.score <= 1 for r in got)
    assert decontam.contaminated(documents(rows), bench.limit(0)).count() == 0
    assert decontam.contaminated(documents([]), bench).count() == 0


def test_edited_and_cut_items_in_many_documents(documents, spark):
    r = random.Random(8)
    edited, part = ([f"{name}{k}" for k in range(30)] for name in "ab")
    changed = ["other" if k % 6 == 5 else w for k, w in enumerate(edited)]
    noise = lambda: [f"n{r.randrange(10**6)}" for _ in range(40)]
    rows = [(k, " ".join(noise() + changed + noise())) for k in range(50)] + [(100 + k, " ".join(noise() + part[:20] + noise())) for k in range(2)]
    rows += [(200 + k, " ".join(noise() + part[20 + k : 23 + k] + noise())) for k in range(8)]  # rarer n-grams of an item elsewhere
    bench = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(part))], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontam.contaminated(documents(rows), bench).collect()}
    assert set(got) == {(k, 1) for k in range(50)} | {(100, 2), (101, 2)}
    assert all(got[k, 1] == pytest.approx(23 / 30) for k in range(50)) and got[100, 2] == pytest.approx(2 / 3)


def test_spared_alignments_reach_no_score():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.integers(0, 12, r.integers(1, 30)), r.integers(0, 12, r.integers(8, 20))
        assert decontam.may_reach(a, b, 0.5) or decontam.align(a, b) < 0.5


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(b))


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(8)
    for _ in range(50):
        a, b = r.integers(0, 5, r.integers(1, 30)), r.integers(0, 5, r.integers(1, 20))
        assert decontam.align(a, b) == plain_align(a, b)


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_url_rules_and_list(spark):
    rows = [
        (1, "http://EXAMPLE.net/en/x"), (2, "http://a.example.net/de"), (3, "http://notexample.net/en/"), (4, "https://example.com/de/?a://b"), (5, "http://x.org/fr/1"), (6, "http://x.org"),
        (7, None), (8, "no url"), (9, "http://net"), (10, "http://www.listed.com/p.html?utm_source=x#f"), (11, "https://m.listed.com/p/"), (12, "http://listed.com/q"), (13, "http://listed.com/p?ref=z&k=1"), (10, "http://www.listed.com/p"), (None, "://"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("listed", F.lit(5)).withColumn("block", F.lit(1))
    listed = spark.createDataFrame([("listed.com/p",), ("listed.com/p",), (None,)], "canonical string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed, RULES).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert got == [
        (1, "example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/de", "net/", "block"), (3, "notexample.net", "/en/", "net/", "block"),
        (4, "example.com", "/de/", "example.com/de/", "block"), (5, "x.org", "/fr/1", "org/fr/", "allow"), (6, "x.org", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (9, "net", "", None, "allow"), (10, "www.listed.com", "/p", None, "block"), (10, "www.listed.com", "/p.html", None, "block"), (11, "m.listed.com", "/p/", None, "block"), (12, "listed.com", "/q", None, "allow"),
        (13, "listed.com", "/p", None, "allow"), (None, "", "", None, "allow"),
    ]
    assert urlfilter.judge(pages, listed.limit(0), RULES).filter("listed").count() == 0
    assert urlfilter.judge(pages.limit(0), listed, RULES).count() == 0


def test_bloom_has_no_false_negative(spark, monkeypatch):
    urls = spark.range(3000).select(F.concat(F.lit("h.com/"), "id").alias("canonical"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), "id").alias("url"))
    for bound in (1 << 20, 0):  # 0: the filter is joined by a shuffle
        monkeypatch.setattr(urlfilter, "MAX_BROADCAST_BLOCKS", bound)
        got = urlfilter.judge(pages, urls, [])
        assert got.filter("listed").agg(F.count("page_id"), F.max("page_id")).first()[:] == (3000, 2999)


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_like_plain_patterns(documents, spark):
    r = random.Random(12)
    fixed = [
        "é\U0001f600 mail a.b@c-d.e.f, 001.2.3.4 and 256.1.1.1; 4111 1111 1111 1111", "+49 (0)30 123-4567 x", "a@b.c%d@e.f", "@x.y a@b", "1.2.3.4.5.6.7.8", "+1 2", "12345678901234567890 4111-1111-1111-1111-",
        "99999999999999999999.1.1.1", None, "", "a@b.c@d.e", "+4930123456789", "0000000000000",
    ]
    rows = list(enumerate(fixed + ["".join(r.choice("0123456789.+-@ ()ab") for _ in range(r.randint(1, 120))) for _ in range(300)]))
    got = {x.doc_id: x for x in documents(rows).select("doc_id", sanitize.span_text(sanitize.base_spans(F.col("text"))).alias("s")).collect()}
    for i, t in rows:
        assert got[i].s == plain_spans(t), repr(t)


def test_disclosing_terms_and_sanitised_text(documents):
    rows = [(k, f"line {k} filler words number{k} Mira Quell mira@site.org closing part {k} of it") for k in range(6)]
    rows += [(100 + k, f"plain text {k} closing filler words part of it and line here") for k in range(60)] + [(200, None), (201, ""), (0, rows[0][1])]
    docs = documents(rows).withColumn("row", F.lit(7))
    clean = sanitize.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert "mira" not in texts[1].lower() and "Quell" not in texts[1] and "[EMAIL]" in texts[1] and "closing part 1" in texts[1]
    assert texts[100] == rows[6][1] and texts[200] is None and texts[201] == ""
    assert sanitize.spans(documents([])).count() == 0


def test_copies_do_not_hide_disclosing_terms(documents):
    page = "line of words Mira Quell mira@site.org closing part"
    rows = [(k, page) for k in range(60)] + [(100, "other text here Mira Quell mira@site.org and more of it")]
    rows += [(200 + k, f"plain line {'abcdefgh'[k % 8] * 3} of words and closing part {k} here other text more of it") for k in range(200)]
    got = {r.doc_id: [s["value"] for s in r.terms] for r in sanitize.spans(documents(rows)).collect()}
    assert got[0] == got[59] == got[100] == ["remove", "remove", "remove"][: len(got[100])] and len(got[0]) >= 2
    assert not any(got[200 + k] for k in range(200))


def test_terms_beside_an_entity_of_one_text(documents):
    rows = [(1, "some words of Mira Quell mira@site.org closing part")] + [(200 + k, f"plain words of {'abcdefgh'[k % 8] * 3} and closing part of some text") for k in range(200)]
    texts = {r.doc_id: r.text for r in sanitize.sanitised(documents(rows)).collect()}
    assert texts[1].split() == "some words of [EMAIL] closing part".split() and all(texts[i] == t for i, t in rows[1:])


def test_pipeline_stages(spark, documents, odd_rows):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = corpus_pipeline.identify_language(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == set(before)  # all of them have a language
    groups = brute_groups(list(before.items()))
    once = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in once.collect()} == {i for i, (_, c) in groups.items() if i == c}
    bench = [r.text.lower() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, sf).collect()}
    assert not any(b in before[i].lower() for i in clean for b in bench)
    masked = {r.doc_id: r for r in corpus_pipeline.sanitise(spark, docs, sf).collect()}
    assert set(masked) == set(before)
    for i, r in masked.items():
        assert r.n_chars == len(r.text) and (plain_spans(before[i]) or r.text == before[i])
        assert not (plain_spans(before[i]) and r.text == before[i])
    for r in corpus_pipeline.tokenize(spark, docs, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_on_odd_rows(spark, documents, odd_rows, name, stage):
    docs = documents([(i, t, "en") for i, t in odd_rows]).withColumn("kept", F.lit(1)).withColumn("score", F.lit("s"))
    got = stage(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    rows = got.collect()
    ids = defaultdict(int)
    for r in rows:
        ids[r.doc_id] += 1
    wanted = {"language_id": {4: 1, 5: 2, 6: 2, None: 1, 8: 1}, "minhash_dedup": {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, None: 1, 7: 1, 8: 1}}
    assert dict(ids) == wanted.get(name, {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 2, None: 1, 7: 1, 8: 1})
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_stages_on_clashing_and_few_columns(spark, documents, odd_rows):
    sf = "/root/testdata/sf0.001"
    docs = documents([(i, t, "en") for i, t in odd_rows])
    clash = docs.withColumns({"_n": F.lit("x"), "_row": F.lit("r"), "_spans": F.lit("s"), "found_id": F.lit(1), "tags": F.create_map(F.lit("a"), F.col("doc_id"))})
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, clash, sf)
        assert got.columns == clash.columns
        assert {(r["_n"], r["_row"], r["_spans"], r.found_id) for r in got.collect()} == {("x", "r", "s", 1)}
    few = corpus_pipeline.drop_near_duplicates(spark, docs.select("doc_id", "text"), sf).collect()
    assert sorted(r.doc_id or 0 for r in few) == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    coded = corpus_pipeline.tokenize(spark, clash, sf).collect()
    assert len(coded) == len(odd_rows) and all(r.n_tokens == len(r.ids) for r in coded)
    assert corpus_pipeline.tokenize(spark, docs.limit(0), sf).count() == 0


def test_contaminated_document_without_an_id_goes(spark, documents):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    kept = corpus_pipeline.decontaminate(spark, documents([(None, f"before {item} after"), (1, "clean words only"), (2, item)]), sf)
    assert [r.doc_id for r in kept.collect()] == [1]


def test_pipeline_runs_on_empty_and_odd_tables(spark, documents, odd_rows, tmp_path):
    for name, rows in (("none", []), ("odd", odd_rows)):
        documents([(i, t, "en") for i, t in rows]).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} == ({None, 4, 5, 6, 8} if rows else set())
