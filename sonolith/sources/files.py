"""Reading files with fixed schemas, and contracts on what was read."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table; a path that doesn't exist is a table without rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t") -> DataFrame:
    """Delimited text with a header, in a declared schema; a row that doesn't fit fails the read."""
    return spark.read.csv(path, sep=separator, schema=schema, header=True, mode="FAILFAST")


def read_counts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines in a declared schema; what doesn't parse fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def traces(files: DataFrame, content: str = "content") -> DataFrame:
    """Fixes of JSON traces: an object with an address, a start and rows [seconds, lat, lon, altitude or "ground", speed]."""
    kind = "struct<address:string,start:double,rows:array<array<string>>>"
    parsed = files.select(F.from_json(F.col(content).cast("string"), kind).alias("t"))
    rows = parsed.select("t.address", "t.start", F.posexplode("t.rows").alias("i", "r"))
    ground = F.get("r", F.lit(3)) == "ground"
    return rows.select(
        "address",
        F.col("i").alias("point"),
        (F.col("start") + F.get("r", F.lit(0)).try_cast("double")).alias("t"),
        F.get("r", F.lit(1)).try_cast("double").alias("lat"),
        F.get("r", F.lit(2)).try_cast("double").alias("lon"),
        F.when(~ground, F.get("r", F.lit(3)).try_cast("double")).alias("altitude_ft"),
        F.coalesce(ground, F.lit(False)).alias("on_ground"),
        F.get("r", F.lit(4)).try_cast("double").alias("speed_kt"),
    )


def require_stamp(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """The table, if its column carries the stamp; an error before any work is done otherwise."""
    found = df.schema[column].metadata.get(key)
    if found != value:
        raise ValueError(f"{column}: {key} is {found!r}, not {value!r}")
    return df


def stamp(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """The table with a stamp on a column; Parquet keeps it."""
    return df.withMetadata(column, {**df.schema[column].metadata, key: value})


def positive(value: Column) -> Column:
    """The value where it is a number above zero, else null."""
    return F.when(~F.isnan(value) & (value > 0), value)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written table carries the marker that is written last."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces just the partitions that df has rows of; the commit is atomic for the job, and the marker comes last."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True).close()


def missing_partitions(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_tables(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two independent runs: equal ones once, those of one alone kept, different ones an error."""
    x, y = a.select(*keys, F.col(value).alias("__a")), b.select(*keys, F.col(value).alias("__b"))
    j = x.join(y, keys, "full")
    clash = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))
    merged = F.when(clash, F.raise_error(F.lit("two runs differ"))).otherwise(F.coalesce("__a", "__b"))
    return j.select(*keys, merged.cast(a.schema[value].dataType).alias(value))


def pack_ipc(df: DataFrame) -> DataFrame:
    """The table as Arrow IPC streams, one binary row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return df.mapInArrow(run, "content binary")


def read_ipc(files: DataFrame, schema: T.StructType, content: str = "content") -> DataFrame:
    """Rows of Arrow IPC streams held in a binary column (such as Spark's binaryFile source gives): only the columns of
    the schema are decoded."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                with pa.ipc.open_stream(blob.as_buffer()) as stream:
                    for inner in stream:
                        yield inner.select(names)

    return files.select(content).mapInArrow(run, schema)


def compress(df: DataFrame, name: str, text: str, spoil: str) -> DataFrame:
    """(name, content): texts gzipped as members of an archive; those marked by `spoil` are cut short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, bad = (batch.column(c).to_pylist() for c in (name, text, spoil))
            blobs = [gzip.compress(t.encode(), mtime=0) for t in texts]
            blobs = [b[: len(b) // 2] if s else b for b, s in zip(blobs, bad, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blobs, pa.binary())], names=["name", "content"])

    return df.select(name, text, spoil).mapInArrow(run, "name string, content binary")


def read_members(archive: DataFrame) -> DataFrame:
    """(name, content, fault): the text of each gzipped member, or what is wrong with it; a corrupt member never fails the
    others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, faults = [], []
            for blob in batch.column("content").to_pylist():
                try:
                    texts.append(gzip.decompress(blob).decode())
                    faults.append(None)
                except (EOFError, OSError, UnicodeDecodeError, zlib.error):
                    texts.append(None)
                    faults.append("corrupt")
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(texts, pa.string()), pa.array(faults, pa.string())], names=["name", "content", "fault"]
            )

    return archive.select("name", "content").mapInArrow(run, "name string, content string, fault string")


def unescape_opl(text: Column) -> Column:
    """OPL text: %hex% stands for the character of that number."""
    parts = F.split(text, "%")
    return F.array_join(
        F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.decode(F.unhex(F.lpad(x, 8, "0")), "UTF-32")).otherwise(x)), ""
    )


def opl_tags(line: Column) -> Column:
    """The tags of an OPL line (its field T) as a map."""
    field = F.regexp_extract(line, r"(?:^| )T(\S*)", 1)
    pairs = F.transform(F.split(field, ","), lambda p: F.split(p, "="))
    full = F.filter(pairs, lambda p: F.size(p) == 2)
    return F.map_from_entries(F.transform(full, lambda p: F.struct(unescape_opl(F.get(p, F.lit(0))), unescape_opl(F.get(p, F.lit(1))))))
