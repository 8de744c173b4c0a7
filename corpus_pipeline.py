"""From raw documents to token ids: language identification, near-duplicate removal, benchmark decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of docs. Null and empty texts
have no language and leave at the first stage; empty tables pass through every stage as empty ones.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dwellgraph.llm import bytebpe, decontam, langid, minhash, sanitize
from dwellgraph.session import shared_dir, ship

ORACLE_SQL = None  # the stages are tested against brute-force versions


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go. The model learns from the documents' own language labels."""
    ship(spark)
    return langid.recognised(docs, langid.train(docs, public_tokenizers.path("piece_bpe_32k.model")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of repeated rows one; documents without words stay, rows without
    an id too. An id goes with all its rows if one of them goes."""
    ship(spark)
    gone = minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if repeated.isEmpty():
        return kept
    # The first by the text of all other columns, which also a map has.
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    n, others = free("_n"), [c for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    again = kept.join(repeated, "doc_id", "left_semi").withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    ship(spark)
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["found_id"]), "left_anti")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, terms that give it away are generalised or removed; n_chars follows the text."""
    ship(spark)
    clean = sanitize.sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids, and a digest of the text that they decode to."""
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bytebpe.round_trip(docs, path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language), ("minhash_dedup", drop_near_duplicates), ("decontamination", decontaminate), ("personal_data", sanitise),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each result is written as Parquet in the shared folder and read by the next stage."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
