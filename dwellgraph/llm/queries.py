"""Registered queries of this subpackage: each operator over its whole table. Each takes (spark, sf_dir)."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ship
from . import bytebpe, decontam, htmlcrf, imatch, langid, merkle, minhash, mixing, records, sanitize, toxicity, turns, urlfilter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    @functools.wraps(f)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = shipped
    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(data: Column | str) -> Column:
    return F.sha2(data, 256)


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


# Rules of the URL query, and what makes a host one whose pages are listed.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED_HOSTS = "(^|[.-])(spam|cheap|pills|casino|farm)[.-]"


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page; the listed URLs are those of hosts with a spam word in their name."""
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    listed = pages.filter(urlfilter.host_of(url).rlike(LISTED_HOSTS)).select(urlfilter.canonical(url).alias("canonical"))
    return urlfilter.judge(pages, listed, RULES)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item of the benchmark, copied, edited or paraphrased."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.filter(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents")
    return imatch.compared(docs, imatch.lexicon(docs))


@query
def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to record files and read back."""
    written = records.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return records.read(written).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = langid.remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bytebpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _hex(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_sha256"), _hex("decoded").alias("decoded_sha256"),
    )


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return htmlcrf.extract(pages, htmlcrf.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and the terms that give them away."""
    found = sanitize.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == sanitize.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        _hex(sanitize.span_text(F.col("base")).cast("binary")).alias("base_sha256"), sanitize.span_text(F.array_sort(F.concat("base", "terms"))).alias("spans"),
    )


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and whether a text that was tampered with still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = fields(F.col("text"))
    tampered = F.when(langid.remainder(F.col("doc_id"), 3) == 0, fields(lowered)).otherwise(leaf)
    proved = merkle.manifest(docs.select("doc_id", "lang", leaf.alias("leaf"), tampered.alias("tampered")), "lang", ["doc_id"], "leaf")
    proved = proved.withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("witness")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", _hex(merkle.siblings(F.col("witness")).cast("binary")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by rule and repaired by the cheapest edits."""
    given = table(spark, sf_dir, "conversations")
    return turns.audited(given, turns.damaged(given))


@query
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix with weighted sources takes."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
