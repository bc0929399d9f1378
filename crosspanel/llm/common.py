"""What the corpus operators share: tables, the shared folder and bounded Arrow batches."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes that Spark puts into one Arrow batch for a Python worker at most; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


#: Bytes of a table that is dealt out anew, if it has fewer files than the session has cores: so few that moving them costs less than idle cores.
SMALL_TABLE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. A small one in few files, whose row groups are too few for all cores, is dealt to all of them; larger ones are read as they stand."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


@functools.lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, one of the machine's own serves a local session, as in tests; on a cluster that is an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or _own_dir(spark.sparkContext.applicationId)


def stored(df: DataFrame, label: str, fmt: str = "parquet", **options) -> DataFrame:
    """Writes `df` as a table in the shared folder and returns the table. It cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).format(fmt).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path)


#: A key is hot if it has more rows than its share, one part in SHARES for each shuffle partition, and more than LEAST_HOT.
SHARES, LEAST_HOT = 4, 256


def hot_keys(rows: DataFrame, key: str, total: int | None = None, each: str | None = None) -> DataFrame | None:
    """The hot keys of `rows` and `_salts`, the number of shares each of them has; None if there are none. Counts are combined before they move. As every hot key has more than a share of all rows, there are fewer than SHARES times the shuffle partitions of them, whatever the table, so that they may be broadcast. `rows` is a stored table, or `total` tells its rows; `each` is a column of counts, if `rows` has been counted."""
    parts = SHARES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(LEAST_HOT, -(-(rows.count() if total is None else total) // parts))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")) if each is None else rows.select(key, F.col(each).alias("_n"))
    hot = stored(counts.where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")), "hot")
    return None if hot.isEmpty() else hot


def met(rows: DataFrame, facts: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row a key. The rows of a hot key are dealt by the hash of `by` to as many tasks as it has shares, and its row of `facts` goes to each of them."""
    if hot is None:
        return rows.join(facts, key)
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    right = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def ranked(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """`df` with position, from 0 in each group `by` in the order of `order`. Rows are sorted in ranges over all tasks, so a group that is a large part of the table is many tasks' work; a range is numbered by itself, and the rows of its group in earlier ranges are added. Groups are not null."""
    own = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by, *order, "_row").withColumn("_range", F.spark_partition_id())
    own = stored(own, label)
    counts = own.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order, "_row"))
    met = own.withColumn("_nth", nth).join(counts.select("_range", *by, F.coalesce(before, F.lit(0)).alias("_before")), ["_range", *by])
    return met.select(*df.columns, (F.col("_before") + F.col("_nth") - 1).alias("position"))


def bounded_batches(spark: SparkSession) -> None:
    """The same two bounds for all operators, so that none changes what another has set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def larger_batches(batches, most_bytes: int = BATCH_BYTES):
    """The batches of a task put together up to `most_bytes`, for operators that gain from many rows at once."""
    waiting, held = [], 0
    for b in batches:
        if waiting and held + b.nbytes > most_bytes:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, held = [], 0
        if b.num_rows:
            waiting.append(b)
            held += b.nbytes
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text only; a null text is the empty text. Columns of other names, and clashing ones, play no part."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def arrow_rows(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], types[k]) for k in types], names=list(types))


def with_texts(b: pa.RecordBatch, new: list, text: str = "text", length: str = "n_chars") -> pa.RecordBatch:
    """A batch of documents with new texts, without the rows whose new text is None. A row whose text stays (null: empty) is left as it is; else the length column, if any, follows."""
    names = b.schema.names
    at = names.index(text)
    old = b.column(at).to_pylist()
    changed = [n is not None and n != (t or "") for t, n in zip(old, new)]
    columns = list(b.columns)
    if any(changed):
        columns[at] = pa.array([n if c else t for t, n, c in zip(old, new, changed)], columns[at].type)
        if length in names:
            k = names.index(length)
            columns[k] = pa.array([len(n) if c else x for x, n, c in zip(columns[k].to_pylist(), new, changed)], columns[k].type)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array([n is not None for n in new], pa.bool_()))


def map_texts(docs: DataFrame, decide, text: str = "text") -> DataFrame:
    """`docs` with its own columns after `decide`, which gets a list of texts (null: empty) and gives for each the text to go on with, or None to drop the row."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield with_texts(b, decide([t or "" for t in b.column(at).to_pylist()]), text)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
