"""Files of the panel library: sinks and sources in text formats and Parquet, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-panel-", dir="/tmp")


def base_path(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, one of the machine's own serves a local session, as in tests; on a cluster that is an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or _own_dir(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{base_path(spark)}/{label}-{uuid.uuid4().hex}"


def write_binary(df: DataFrame, base: str) -> int:
    """Writes each row's `content` (bytes) to the file `path` under `base`, by the tasks that hold the rows, and returns the number of files. A file
    appears whole or not at all, so a task that runs again leaves the same files. `base` can be in any file system that pyarrow reaches from the executors."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                system, target = pa_fs.FileSystem.from_uri(f"{base}/{path}")
                folder, name = target.rsplit("/", 1)
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/_{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(content.as_buffer() or b"")
                system.move(hidden, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["files"])

    return df.select("path", "content").mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and content of all files below `path` whose names match; files without a byte are passed over, as Spark does. Few large files go to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "content")


def by_year(df: DataFrame, path: str, date: str = "date") -> DataFrame:
    """Parquet in one folder a year, whose dates are dealt to many tasks. A condition on the year skips folders, one on the date skips row groups."""
    df.withColumn("year", F.year(date)).repartition("year", date).write.partitionBy("year").parquet(path)
    return df.sparkSession.read.parquet(path)


def csv_table(df: DataFrame, path: str, **options) -> DataFrame:
    """CSV with a header unless the options say otherwise, read again under the same schema; an empty field is null."""
    how = {"header": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"} | options
    df.write.options(**how).csv(path)
    return df.sparkSession.read.schema(df.schema).options(**how).csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinity become null in all columns of doubles, as JSON has no word for them."""
    out = {n: F.when(~F.isnan(n) & (F.abs(F.col(n)) != float("inf")), F.col(n)) for n, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(out) if out else df


def json_number(c: Column) -> Column:
    """The text of a number of at most six decimals in its shortest form, as 0.00012 and 1.2e-05: an exponent only below 0.0001. Spark's own text has one below 0.001 and other digits; null where `c` is no finite number."""
    exact = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).cast("decimal(38,6)")
    plain = F.regexp_replace(exact.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    plain = F.when(exact == 0, "0.0").otherwise(plain)
    millionths = F.abs(exact * 1_000_000).cast("int")
    ones, tens = F.floor(millionths / 10).cast("string"), (millionths % 10).cast("string")
    short = F.when(millionths < 10, F.concat(tens, F.lit("e-06"))).otherwise(F.concat(ones, F.when(tens != "0", F.concat(F.lit("."), tens)).otherwise(""), F.lit("e-05")))
    return F.when((exact != 0) & (F.abs(exact) < 0.0001), F.concat(F.when(exact < 0, "-").otherwise(""), short)).otherwise(plain)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    without_nan(df).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
