"""Raw files of a market: daily files in two layouts, index files, small side tables, binary series and reply documents."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the two layouts that hold the fields of one row of a day.
OLD = {"date": "TIMESTAMP", "symbol": "SYMBOL", "isin": "ISIN", "series": "SERIES", "open": "OPEN", "high": "HIGH", "low": "LOW", "close": "CLOSE", "prevclose": "PREVCLOSE", "volume": "TOTTRDQTY", "value": "TOTTRDVAL"}
NEW = {"date": "TradDt", "symbol": "TckrSymb", "isin": "ISIN", "series": "SctySrs", "open": "OpnPric", "high": "HghPric", "low": "LwPric", "close": "ClsPric", "prevclose": "PrvsClsgPric", "volume": "TtlTradgVol", "value": "TtlTrfVal"}
SEGMENT, INSTRUMENT = "CM", "STK"
TEXTS = ("symbol", "isin", "series")
CLEAN = "100"


def number(c: Column) -> Column:
    """A number as people write it, with commas; what is none is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def day_files(spark: SparkSession, old: str, new: str, series: tuple[str, ...]) -> DataFrame:
    """Rows of the daily files of both layouts as one table: date, symbol, isin, series, open, high, low, close, prevclose, volume and value.

    Of the new layout only shares of the cash segment count, and of both only the given series. Columns are found by their
    names, in any order; a file's other columns play no part.
    """

    def layout(path: str, names: dict[str, str], when: Column) -> DataFrame:
        x = spark.read.options(header="true", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true").csv(path)
        fields = [when.alias("date"), *((F.nullif(F.trim(names[k]), F.lit("")) if k in TEXTS else number(F.col(names[k]))).alias(k) for k in names if k != "date")]
        if "Sgmt" in x.columns:
            x = x.where((F.trim("Sgmt") == SEGMENT) & (F.trim("FinInstrmTp") == INSTRUMENT))
        return x.select(*fields)

    both = layout(old, OLD, F.to_date(F.initcap(OLD["date"]), "dd-MMM-yyyy")).unionByName(layout(new, NEW, F.to_date(NEW["date"])))
    return both.where(F.upper("series").isin(*series))


#: Names of columns that tell segment and instrument, where a layout has them.
MARKS = {"segment": "Sgmt", "instrument": "FinInstrmTp"}
NUMBERS = tuple(k for k in OLD if k not in ("date", *TEXTS))


#: Rows of a day's file that are taken apart at a time.
PIECE = 10_000


def _day_pieces(content: bytes) -> Iterator[dict[str, list]]:
    """The fields of one zipped day as texts, PIECE rows at a time. Columns are found by any of their names, whatever blanks and capitals; ValueError, before any piece, says why there are none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            inside = [n for n in z.namelist() if n.lower().endswith(".csv")]
            if not inside:
                raise ValueError("no CSV inside")
            text = z.read(inside[0])
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError) as e:
        raise ValueError("no archive") from e
    table = csv.reader(io.TextIOWrapper(io.BytesIO(text), "utf-8-sig", "replace", newline="\n"), skipinitialspace=True)
    header = {name.strip().lower(): k for k, name in reversed(list(enumerate(next(table, []))))}
    places = {}
    for field in (*TEXTS, *NUMBERS):
        known = [header[n.lower()] for n in (OLD[field], NEW[field]) if n.lower() in header]
        if not known and field != "isin":
            raise ValueError(f"no column for {field}")
        places[field] = known[0] if known else None
    places |= {field: header.get(n.lower()) for field, n in MARKS.items()}
    marked = any(places[k] is not None for k in MARKS)
    cell = lambda row, k: row[k].strip() or None if k is not None and k < len(row) else None
    while some := list(itertools.islice(table, PIECE)):
        rows = [r for r in some if r]
        yield {field: [cell(r, k) for r in rows] for field, k in places.items()} | {"marked": [marked] * len(rows)}


def zipped_day_files(found: DataFrame) -> DataFrame:
    """Rows of zipped daily files (path, content), each with file, day (from the file's name), the fields as texts, and error: null, or why a file, which then has one
    row, could not be read. Each file is a task's work by itself, and its header is matched by itself."""
    kinds = {"file": pa.string(), "day": pa.string(), "error": pa.string(), "marked": pa.bool_()} | {k: pa.string() for k in (*MARKS, *TEXTS, *NUMBERS)}

    def batch(columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in kinds.items()], names=list(kinds))

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                file = path.rsplit("/", 1)[-1]
                day = file.split(".")[0]
                try:
                    if not (len(day) == 8 and day.isdigit()):
                        raise ValueError("no day in the name")
                    for columns in _day_pieces(content.as_py() or b""):
                        n = len(columns["symbol"])
                        yield batch(columns | {"file": [file] * n, "day": [day] * n, "error": [None] * n})
                except ValueError as e:
                    yield batch({k: [None] for k in kinds} | {"file": [file], "day": [day], "error": [str(e)]})

    return found.mapInArrow(run, ", ".join(f"{k} {'boolean' if t == pa.bool_() else 'string'}" for k, t in kinds.items()))


def good_rows(read: DataFrame, series: tuple[str, ...]) -> DataFrame:
    """date, symbol, isin, series, prices, volume and value of the files that could be read: of the given series, and of shares of the cash segment where a layout says so."""
    shares = ~F.col("marked") | ((F.upper("segment") == SEGMENT) & (F.upper("instrument") == INSTRUMENT))
    x = read.where(F.col("error").isNull() & shares).withColumn("series", F.upper("series")).where(F.col("series").isin(*series))
    return x.select(F.to_date("day", "yyyyMMdd").alias("date"), *TEXTS, *(number(F.col(k)).alias(k) for k in NUMBERS))


def bad_files(read: DataFrame) -> DataFrame:
    return read.where(F.col("error").isNotNull()).select("file", "day", "error")


def index_files(spark: SparkSession, path: str, aliases: DataFrame) -> DataFrame:
    """date, index (the name that `aliases` gives to how it is written), open and close of index files, whose numbers are text with commas."""
    x = spark.read.option("header", "true").csv(path)
    x = x.select(F.lower(F.trim("Index Name")).alias("written"), F.to_date("Index Date", "dd-MM-yyyy").alias("date"), number(F.col("Open Index Value")).alias("open"), number(F.col("Closing Index Value")).alias("close"))
    return x.join(F.broadcast(aliases), "written").select("date", "index", "open", "close")  # people keep the aliases


def commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV table with a header and comments after #; blank fields are null."""
    x = spark.read.options(header="true", comment="#", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true").schema(schema).csv(path)
    return x.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in x.columns))


def flag_file(spark: SparkSession, path: str, symbol: int, flags: dict[int, str], stage: int) -> DataFrame:
    """symbol and flags of a file whose fields are told by their place alone: other values than CLEAN are flags, and the one
    at `stage` says its stage. Short rows and a header, whose flag fields are no numbers, go."""
    most = max([symbol, stage, *flags])
    f = F.split("value", ",")
    text = lambda k: F.trim(F.get("f", F.lit(k)))
    x = spark.read.text(path).select(f.alias("f")).where(F.size("f") > most).where(text(min(flags)).rlike(r"^\d+$"))
    on = [F.when(text(k) != CLEAN, F.concat(F.lit(name), F.lit(" (stage "), text(k), F.lit(")")) if k == stage else F.lit(name)) for k, name in flags.items()]
    return x.select(F.upper(text(symbol)).alias("symbol"), F.array_compact(F.array(*on)).alias("flags"))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the newest of the text files under `path`."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    last = x.agg(F.max_by("file", F.struct("at", "file")).alias("file"))
    return x.join(F.broadcast(last), "file", "left_semi").select("value")  # one row


def tidy_header(x: DataFrame) -> DataFrame:
    """Column names trimmed and in lower case."""
    return x.toDF(*(c.strip().lower() for c in x.columns))


def binary_series(files: DataFrame) -> DataFrame:
    """path, at (the row of the calendar) and value of binary series, as the binaryFile source reads them: 32-bit floats, the
    first of which is the row where the series starts; values that are no number are null."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                v = np.frombuffer(content.as_py() or b"", "<f4")
                if len(v):
                    values = v[1:].astype(np.float64)
                    at = int(v[0]) + np.arange(len(values), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(values), pa.string()), pa.array(at), pa.array(values, mask=np.isnan(values))], names=["path", "at", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, at long, value double")


def panel_of(series: DataFrame, calendar: DataFrame, fields: list[str], begin: str, end: str) -> DataFrame:
    """date, code and one column for each field of series (code, field, at, value) within the dates; `calendar` has at and date."""
    days = calendar.where(F.col("date").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    return series.join(F.broadcast(days), "at").groupBy("date", "code").pivot("field", fields).agg(F.first("value"))


def new_rows(arrived: DataFrame, known: DataFrame, key: list[str], empty: DataFrame) -> DataFrame:
    """What arrived and is not yet known by its key, without days that are known to have nothing."""
    return arrived.join(known.select(*key), key, "left_anti").join(empty, empty.columns, "left_anti")
