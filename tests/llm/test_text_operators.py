"""Operators on single texts against the libraries, plain definitions and held-out rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from dwellgraph.llm import bytebpe, htmlcrf, imatch, langid, queries, records, toxicity
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def tricky_texts():
    r = random.Random(5)
    out = ["", " ", "\n\n x", "a  b", "it's 'll x's", "\0a b\0", "tab\tand \x1c y\x85z", "!!" * 400, "ab" * 700, "Ünï—cödé  中文字 \U0001f600", "x\n", " lead", "<|endoftext|> a"]
    out += ["".join(r.choice("thearin s'1é\n\t.,A") for _ in range(r.randint(1, 200))) for _ in range(200)]
    return out


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_that_of_the_library():
    texts, lib = tricky_texts(), library()
    bpe = bytebpe.loaded(RANKS, public_tokenizers.PATTERN)
    ids, bounds = bpe.encode(texts)
    for k, t in enumerate(texts):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert own == lib.encode_ordinary(t), repr(t)
        assert bpe.decode(own).decode() == t


def test_byte_bpe_cache_limit(monkeypatch):
    texts, lib = tricky_texts(), library()
    bpe = bytebpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    bpe.chunks.limit = bpe.pieces.limit = 20
    for a in range(0, len(texts), 7):
        ids, bounds = bpe.encode(texts[a : a + 7])
        assert [ids[b:c].tolist() for b, c in zip(bounds, bounds[1:])] == [lib.encode_ordinary(t) for t in texts[a : a + 7]]


def test_byte_bpe_odd_rows(documents, odd_rows):
    docs = documents(odd_rows).withColumn("ids", F.lit(1))
    got = bytebpe.decode(bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, bytes(r.decoded).decode()) for r in got], key=key) == sorted([(i, t or "") for i, t in odd_rows], key=key)
    both = bytebpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids)
    assert sorted(both, key=order) == sorted(got, key=order)
    assert bytebpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pair_table_finds_all_keys():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 20, 5000) << 32 | r.integers(0, 1 << 20, 5000))
    table = bytebpe.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (table.ranks((keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32)) == np.arange(len(keys))).all()
    assert (table.ranks(np.array([5, -1]), np.array([(1 << 21), 3])) == bytebpe.NONE).all()


def test_records_round_trip(spark, documents, odd_rows):
    docs = documents(odd_rows + [(9, t) for t in tricky_texts()[:12]])
    manifest = records.write(docs, WORDS, end_id=2, files=3)
    got = [r.asDict() for r in records.read(manifest, ids=True).collect()]
    lib = Tokenizer.from_file(WORDS)
    wanted = []
    for i, t in sorted([(r[0], r[1]) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        wanted.append((i, lib.encode(t or "", add_special_tokens=False).ids + [2]))
    got.sort(key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids"]) for r in got] == wanted
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += len(r["ids"])
    shuffled = records.shuffled_read(spark, manifest, 3).collect()
    assert sorted((r.start, r.ids) for r in shuffled) == [(r["start"], r["ids"]) for r in got]


def test_word_encoder_is_the_library():
    encoder, lib = records.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = tricky_texts() + ["İstanbul İ ﬁne Ǆ ß ŒUVRE ΟΔΟΣ. ΣΣ e\u0301te\u0301 x" for _ in range(3)] + [" ".join(chr(c) + "a" for c in range(0x80, 0x2100))]
    encoder.words.limit = encoder.cores.limit = 50
    for a in range(0, len(texts), 9):
        ids, bounds = encoder.encode(texts[a : a + 9])
        for t, b, c in zip(texts[a : a + 9], bounds, bounds[1:]):
            assert ids[b:c].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_records_damage_and_empty(documents):
    good = records.frame(b"abc") + records.frame(b"")
    assert records.unframe(good, 0)[0] == b"abc" and records.unframe(good, records.unframe(good, 0)[1])[0] == b""
    for k in range(len(good)):
        bad = good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]
        with pytest.raises(ValueError):
            at = 0
            while at < len(bad):
                _, at = records.unframe(bad, at)
    assert records.read(records.write(documents([]), WORDS, end_id=2)).count() == 0


def test_language_forward_is_the_sum_of_segmentations():
    vocabulary = langid.pieces_of(PIECES)
    p = np.random.default_rng(0).random((len(vocabulary) + 1, 2))
    found, sizes = langid.lattice(["the", "été"], vocabulary)
    alpha = langid.forward(found, p)

    def total(k, end):
        if end == 0:
            return np.ones(2)
        return sum((total(k, end - n) * p[found[k, end - 1, n - 1]] for n in range(1, min(8, end) + 1) if found[k, end - 1, n - 1] >= 0), np.zeros(2))

    for k in range(2):
        assert np.allclose(alpha[k, sizes[k]], total(k, sizes[k]))


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_language_odd_rows(documents, odd_rows):
    docs = documents([(i, t, "en" if i == 4 else None) for i, t in odd_rows]).withColumn("score", F.lit("clash"))
    model = langid.train(docs, PIECES)
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(docs, model).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (7, "und", False), (4, "en", True), (None, "en", True)} <= got
    empty = langid.train(docs.limit(0), PIECES)
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_toxicity_held_out(spark, documents):
    r = random.Random(2)
    words = ["tree", "house", "river", "stone", "bread", "music", "paper", "light", "green", "small"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        if toxic:
            for w in r.sample(["vile", "nasty", "rotten"], 2):
                text.insert(r.randint(0, len(text)), w)
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs, marked = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs.filter("doc_id < 600"), marked.filter("doc_id < 600"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(600, 900)]
    assert min(got[k] for k in held if k % 5 == 0) > max(got[k] for k in held if k % 5)
    assert len(model.places) < 400  # L1 leaves few weights


def test_toxicity_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.score(docs.withColumn("score", F.lit(1)), toxicity.train(docs, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_number_characters_are_no_letters():
    assert langid.words_of("½ ² ① x²y Ⅷ a1b") == ["x", "y", "a", "b"]


def test_fingerprints(spark, documents):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice((0, 3, 40, 200))))) for k in range(120)] + [(500, None), (501, rows_ := "same text here")] + [(502, rows_)]
    docs = documents(rows)
    got = {r.doc_id: r for r in imatch.compared(docs, imatch.lexicon(docs)).collect()}
    ordered = sorted(rows, reverse=True)
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and (edited != t or got[i].near_edited == 1)
    assert got[501].fingerprint == got[502].fingerprint and got[502].near_next == 1
    long = [i for i, t in rows if t and len(t) > 500]
    assert np.mean([got[i].near_edited for i in long]) > np.mean([got[i].near_next for i in long]) + 0.1


def test_fingerprints_of_a_large_group_of_near_copies(documents):
    """A third of the rows are near copies, whose terms are all above the band."""
    r = random.Random(14)
    vocabulary = [f"w{k}" for k in range(6000)]
    base = r.sample(vocabulary, 200)
    rows = [(k, " ".join([r.choice(vocabulary) for _ in range(200)])) for k in range(800)]
    for k in range(800, 1200):
        copy = list(base)
        for at in r.sample(range(200), 6):
            copy[at] = r.choice(vocabulary)
        rows.append((k, " ".join(copy)))
    docs = documents(rows)
    got = {x.doc_id: x.near_next for x in imatch.compared(docs, imatch.lexicon(docs)).collect()}
    assert np.mean([got[k] for k in range(801, 1200)]) > 0.6 and np.mean([got[k] for k in range(1, 800)]) < 0.1


def test_fingerprints_by_plain_rules():
    """Each subset's hash from its terms one by one, in Python's integers."""
    full = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    r = random.Random(15)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice((0, 1, 5, 60, 250)))) for _ in range(25)]
    term = {w: int(imatch.distinct_terms([w])[0][0]) for w in vocabulary}
    band, above = (np.sort(np.array([term[w] for w in part], dtype=np.uint64)) for part in (vocabulary[:40], vocabulary[40:120]))
    seen = imatch.fingerprints(texts, imatch.Lexicon(band, above))
    for text, print_ in zip(texts, seen):
        own = {term[w] for w in text.split()}
        used = own & set(band.tolist())
        used |= own & set(above.tolist()) if len(used) < imatch.FEW * len(own) else set()
        want = {}
        if not used:
            assert print_ == {(-1, 0): mixed(sum(mixed(t) for t in own) + len(own) & full)}
            continue
        first = len(used).bit_length()
        for s in range(first, first + imatch.SCALES_USED):
            want[s, imatch.SUBSETS] = 0
            for j in range(imatch.SUBSETS):
                inside = [t for t in used if all(mixed(t ^ int(imatch._SEEDS[k])) >> j & 1 for k in range(s))]
                if inside:
                    want[s, j] = mixed(sum(mixed(t + s & full) for t in inside) & full) >> 40
        assert print_ == want
    one, two = (" ".join(vocabulary[:40][a : a + 30]) for a in (0, 6))
    a, b = imatch.fingerprints([one, two], imatch.Lexicon(band, above))
    assert abs(imatch.likeness(a, b) - 24 / 36) < 0.2  # the overlap of their terms


def test_fingerprint_odd_rows(documents, odd_rows):
    docs = documents(odd_rows).withColumn("bucket", F.lit(3))
    assert imatch.compared(docs, imatch.lexicon(docs)).count() == len(odd_rows)
    one = documents([(1, "only one")])
    assert imatch.compared(one, imatch.lexicon(one)).first().near_next == 1
    assert imatch.compared(one.limit(0), imatch.lexicon(one.limit(0))).count() == 0


def test_html_layouts_and_pages():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    model = htmlcrf.Crf()
    model.fit([htmlcrf.labelled(p, w) for p, w in htmlcrf.layouts(words, 250)])
    right = wrong = 0
    for page, wanted in htmlcrf.layouts(words, 60, seed=77):
        rows, labels = htmlcrf.labelled(page, wanted)
        same = [a == b for a, b in zip(labels, model.decode(rows))]
        right, wrong = right + sum(same), wrong + len(same) - sum(same)
    assert right / (right + wrong) > 0.98
    page = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First\n para, with <b>bold</b> words here.<br>More."
        "<p>Second paragraph&#33; &eacute;t&eacute;.<div class=ad>Buy now</div><!-- <p>hidden --><script>var p='<p>no</p>'</script></article><section class='comments'><p>I liked this a lot.</p></section><footer>&copy; me</footer>"
    )
    assert htmlcrf.main_text(page, model) == "A & B First para, with bold words here. More. Second paragraph! été."
    for odd in ("", "<", "<p", "plain", "<!-- open", "<script>x", "</div></p>", "<a title='x>y'>t</a>", "&amp", "<p>" * 3000):
        htmlcrf.main_text(odd, model)


def test_hidden_elements_end_where_they_end():
    text = lambda page: " ".join(b.text for b in htmlcrf.blocks_of(page))
    for tag in ("<svg width='1' />", "<video src=x />", "<object data=a>", "<video-player></video-player>", "<template-card>", "<canvas>", "<script-list>", "</svg>"):
        assert text(f"<p>one</p>{tag}<p>two</p><p>three</p>") == "one two three", tag
    assert text("<p>one <svg><title>no</title><svg>no</svg>no</svg>two</p>") == "one two"
    assert text("<object><p>one</p><object>no</object><video>no</video><p>two</p>") == "one two"
    assert text("<p>one</p><script>no<p>no") == "one" and text("<style>no</style><iframe>no</iframe><noscript><p>no</p></noscript>two") == "two"


def test_html_query(spark):
    got = queries.op9_html_text(spark, SMALL).collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 and "©" not in r.text for r in got)
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id long, url string, html string")
    assert htmlcrf.extract(pages, htmlcrf.train(pages)).count() == 3
    assert htmlcrf.extract(pages.limit(0), htmlcrf.train(pages.limit(0))).count() == 0


def test_word_encoder_agrees_with_the_library_on_any_characters():
    encoder = records.WordEncoder(WORDS)
    draw = random.Random(3)
    alphabet = [chr(c) for c in range(0x340)] + list("  \n'''stremvlld,.;1$$") * 20
    texts = ["", " ", "\u0130stanbul's  don't\t \u00b4s", "\x1cx\x1fy \x85", "\u03a3\u0391\u03a3 x\u00b2\u00b3", "E\u0301 a, <|endoftext|>", "'S 'RE 'sx x''s"]
    texts += ["".join(draw.choices(alphabet, k=60)) for _ in range(500)]
    ids, bounds = encoder.encode(texts)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
