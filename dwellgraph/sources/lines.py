"""Text inputs. Every parser takes a frame of lines (value), so any text source can feed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clock import parse_stamp
from .sinks import BUCKETS

LINE = "_line"
FILES_AT_ONCE = 1000


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Lines of text files; numbered adds a column that sorts them as they stand in the files."""
    lines = spark.read.text(path)
    if not numbered:
        return lines
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    return lines.select("value", place.alias(LINE))


def _fields(sep: str = ",") -> Column:
    """Fields of a line; empty fields at its end do not count."""
    return F.split(F.regexp_replace("value", f"{sep}+$", ""), sep)


def _with_fields(lines: DataFrame, n: int, fields: Column | None = None) -> DataFrame:
    return lines.withColumn("_f", _fields() if fields is None else fields).filter(F.size("_f") == n)


def parse_cdr(lines: DataFrame) -> DataFrame:
    """Five-field call records: user, ts, cid. Lines of another length or with an impossible date are dropped."""
    f = F.col("_f")
    return _with_fields(lines, 5).select(
        f[3].alias("user"), parse_stamp(f[1]).alias("ts"), f[4].alias("cid")
    ).filter("ts IS NOT NULL")


def parse_users(lines: DataFrame) -> DataFrame:
    return lines.select(F.split("value", ",")[0].alias("user")).distinct()


def parse_alias(lines: DataFrame) -> DataFrame:
    f = F.split("value", ",")
    return lines.filter(F.size(f) >= 2).select(f[0].alias("cid"), f[1].alias("canon_cid"))


def parse_cells(lines: DataFrame) -> DataFrame:
    """Fourteen-field cell table: cid, name, lon, lat."""
    f = F.col("_f")
    return _with_fields(lines, 14).select(
        f[3].alias("cid"), f[7].alias("name"),
        F.expr("try_cast(_f[12] AS DOUBLE)").alias("lon"), F.expr("try_cast(_f[13] AS DOUBLE)").alias("lat"),
    )


def parse_adjacency(lines: DataFrame) -> DataFrame:
    """'cid <tab> n1,n2,...' to (cid, nbr_cid); with numbered lines the last line of a cid counts."""
    f = F.split("value", "\t")
    rows = lines.filter(F.size(f) >= 2).select(f[0].alias("cid"), f[1].alias("_list"), *_order(lines))
    if LINE in lines.columns:
        rows = rows.groupBy("cid").agg(F.max_by("_list", LINE).alias("_list"))
    return rows.select("cid", F.explode(F.split("_list", ",")).alias("nbr_cid"))


def parse_stays(lines: DataFrame, default_count: int | None = None, keep_empty: bool = False) -> DataFrame:
    """Eight-field stays; with default_count, seven-field lines that lack the count. Empty fields at the end of a line do not count, so a line without
    its last value is dropped; with keep_empty they are nulls, as in files of this library."""
    f = F.col("_f")
    count = F.lit(default_count) if default_count is not None else F.expr("try_cast(_f[7] AS DOUBLE)")
    return _with_fields(lines, 8 if default_count is None else 7, F.split("value", ",") if keep_empty else None).select(
        f[3].alias("user"), f[0].alias("cid"),
        F.expr("try_cast(_f[1] AS DOUBLE)").alias("lon"), F.expr("try_cast(_f[2] AS DOUBLE)").alias("lat"),
        parse_stamp(f[4]).alias("start_ts"), parse_stamp(f[5]).alias("end_ts"),
        F.expr("try_cast(_f[6] AS DOUBLE)").cast("long").alias("stay_s"), count.cast("long").alias("n_records"),
    ).filter("start_ts IS NOT NULL AND end_ts IS NOT NULL")


def parse_edges(lines: DataFrame, weighted: bool = False) -> DataFrame:
    """'src dst [weight]' separated by blanks; text after # is a comment; unweighted edges weigh 1. Lines whose weight is no finite number are dropped."""
    bare = lines.withColumn("_f", F.split(F.trim(F.regexp_replace("value", "#.*$", "")), "\\s+"))
    weight = F.expr("try_cast(_f[2] AS DOUBLE)") if weighted else F.lit(1.0)
    rows = bare.filter(F.size("_f") >= (3 if weighted else 2))
    return rows.select(
        F.expr("try_cast(_f[0] AS BIGINT)").alias("src"), F.expr("try_cast(_f[1] AS BIGINT)").alias("dst"),
        weight.alias("weight"), *[F.col(LINE).alias("seq") for _ in _order(lines)],
    ).dropna(subset=["src", "dst", "weight"]).filter(F.abs("weight") < float("inf"))


def parse_locations(lines: DataFrame) -> DataFrame:
    """'lon,lat,...' lines: lon, lat."""
    rows = lines.withColumn("_f", F.split("value", ",")).filter(F.size("_f") >= 2)
    return rows.select(F.expr("try_cast(_f[0] AS DOUBLE)").alias("lon"), F.expr("try_cast(_f[1] AS DOUBLE)").alias("lat"))


def _order(lines: DataFrame) -> list[str]:
    return [LINE] if LINE in lines.columns else []


def read_cdr(spark: SparkSession, path: str) -> DataFrame:
    return parse_cdr(read_lines(spark, path))


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return parse_users(read_lines(spark, path))


def read_cell_alias(spark: SparkSession, path: str) -> DataFrame:
    return parse_alias(read_lines(spark, path))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return parse_cells(read_lines(spark, path))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    return parse_adjacency(read_lines(spark, path, numbered=True))


def read_stays(spark: SparkSession, path: str, default_count: int | None = None, keep_empty: bool = False) -> DataFrame:
    return parse_stays(read_lines(spark, path), default_count, keep_empty)


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    return parse_edges(read_lines(spark, path, numbered=True), weighted)


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return parse_locations(read_lines(spark, path))


def read_responses(spark: SparkSession, path: str, key: str = "location_key", encoded: bool = False) -> DataFrame:
    """Stored JSON responses, one document per file, keyed by the file name without its extension.

    Spark gives file names percent-encoded, so they are decoded. With encoded, the folder is one that `write_responses` wrote: the names themselves are encoded,
    and tasks list and read its subfolders, and files in the folder itself, without the driver.
    """
    stem = lambda name: F.regexp_replace(name, "\\.[^.]*$", "")
    if encoded:
        # Spark's reader would list all files in the driver, and pack few of them into a task, as it counts megabytes for opening one.
        places = spark.range(0, BUCKETS + 1, 1, BUCKETS + 1)
        return places.mapInArrow(_stored_in(path), "name string, value string").select(F.url_decode(stem("name")).alias(key), "value")
    name = F.replace(stem(F.col("_metadata.file_name")), F.lit("+"), F.lit("%2B"))  # a plus is not a space here
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias(key), "value")


def _stored_in(folder: str):
    """Names and texts of the files in the subfolders with the given numbers; the last number stands for the folder itself."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                within = f"{place}/{bucket:03d}" if bucket < BUCKETS else place
                held = [f.path for f in files.get_file_info(fs.FileSelector(within, allow_not_found=True)) if f.is_file and f.base_name[0] not in "._"]
                for start in range(0, len(held), FILES_AT_ONCE):
                    values = []
                    for name in held[start : start + FILES_AT_ONCE]:
                        with files.open_input_stream(name) as text:
                            values.append(text.read().decode("utf-8", "replace"))
                    names = [name.rsplit("/", 1)[1] for name in held[start : start + FILES_AT_ONCE]]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["name", "value"])

    return run
