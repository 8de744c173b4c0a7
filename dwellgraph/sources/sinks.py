"""Text and table outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.clock import STAMP
from ..functions.text import six_decimals


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as comma-joined text, timestamps as yyyyMMddHHmmss; a null is an empty field."""
    cols = [F.date_format(n, STAMP) if t.startswith("timestamp") else F.col(n).cast("string") for n, t in df.dtypes]
    return df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cols]).alias("value"))


def stay_lines(stays: DataFrame) -> DataFrame:
    """Stays in the field order of the trajectory files."""
    cols = ["cid", "lon", "lat", "user", "start_ts", "end_ts", "stay_s"]
    return csv_lines(stays.select(*cols, *[c for c in stays.columns if c == "n_records"]))


def write_trajectories(df: DataFrame, path: str, single_file: bool = False, fmt: str = "text") -> None:
    """Write stays as text lines or, with fmt='parquet', as a table; one file only on request."""
    out = stay_lines(df) if fmt == "text" else df
    (out.coalesce(1) if single_file else out).write.mode("overwrite").format(fmt).save(path)


def embedding_lines(vectors: DataFrame) -> DataFrame:
    """'N D' header (position 0) and 'node f1 ... fD' rows (position 1): position, node, value."""
    rows = vectors.select(
        F.lit(1).alias("position"), F.col("node"),
        F.concat_ws(" ", F.col("node").cast("string"),
                    F.concat_ws(" ", F.transform("vector", lambda v: six_decimals(v.cast("double"))))).alias("value"),
    )
    head = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).select(
        F.lit(0).alias("position"), F.lit(None).cast("long").alias("node"),
        F.concat_ws(" ", F.col("n").cast("string"), F.coalesce("d", F.lit(0)).cast("string")).alias("value"),
    )
    return head.unionByName(rows)


def write_embeddings(vectors: DataFrame, path: str, single_file: bool = False) -> None:
    lines = embedding_lines(vectors)
    if single_file:
        lines = lines.coalesce(1).sortWithinPartitions("position", "node")
    else:
        lines = lines.orderBy("position", "node")
    lines.select("value").write.mode("overwrite").text(path)


BUCKETS = 512


def write_responses(responses: DataFrame, folder: str, key: str = "location_key") -> None:
    """Responses (key, value) as a file each, named by the percent-encoded key, in a folder that driver and executors share. Of rows with one key any is kept;
    a file is moved into place when it is whole, so a task that runs again replaces its files by the same. Files lie in BUCKETS subfolders by their names, which
    `read_responses` lists and reads in tasks of their own."""
    name = F.concat(F.url_encode(F.col(key).cast("string")), F.lit(".json"))

    def run(batches):
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        made = set()
        for batch in batches:
            for bucket, name, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "name", "value"))):
                within = f"{place}/{bucket:03d}"
                if bucket not in made:
                    files.create_dir(within, recursive=True)
                    made.add(bucket)
                own = f"{within}/.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write(value.encode())
                files.move(own, f"{within}/{name}")
        return iter(())

    named = responses.select(name.alias("name"), F.col("value")).dropna().dropDuplicates(["name"])
    named = named.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int"))
    named.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
