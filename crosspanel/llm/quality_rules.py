"""Quality rules from hashed n-gram likelihood ratios, with DataFrame functions only (operator 3).

Words and pairs of words fall into BUCKETS by hash. One pass counts the buckets over all documents (the raw corpus)
and over all trusted documents (the target): those labelled good.
A document's score is the mean log ratio of the two smoothed multinomials over its words and pairs. The threshold is a
low percentile of the trusted documents' own scores, and every document is held against it.

The counts are added up before the shuffle, so at most BUCKETS rows leave a task, and the ratios come to BUCKETS
numbers however large the corpus is. Trusted ids meet the documents as exact bitmaps, so that texts are not shuffled. The judged rows, without their
texts, are stored once in the shared folder; the percentile is exact, over scores rounded to six digits, so its state
grows with the different scores only.

Defined cases: a null text has no words; a document without words has score null and fails the base rules; equal
scores have equal verdicts; a text of any length is scored whole, in its own row; repeated rows count and return as often as they stand; without trusted documents the ratio
is 0 for all and only the base rules decide; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import stored

BUCKETS = 4096
SMOOTHING = 1.0
PERCENTILE = 0.005
#: Bitmaps of trusted ids that are broadcast at most: 32 MB.
MOST_BITMAPS = 8_000
#: White space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def hashes(text: Column) -> Column:
    """The 64-bit hashes of the words of a text, each made once."""
    return F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _bucket(*hashes: str) -> str:
    """The bucket of a word's hash, or of the pair of a word's hash and that of the word before it."""
    return f"int(pmod({hashes[0] if len(hashes) == 1 else 'xxhash64(' + ', '.join(hashes) + ')'}, {BUCKETS}))"


def _counts(docs: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """How often each bucket is met in trusted documents and in all, in one pass. At most BUCKETS rows reach the driver."""
    both = F.expr(f"concat(transform(h, x -> {_bucket('x')}), transform(h, (x, i) -> {_bucket('if(i = 0, 0L, h[i - 1])', 'x')}))")
    b = docs.select("trusted", F.explode(both).alias("b")).groupBy("b").agg(F.count_if("trusted").alias("t"), F.count("*").alias("n")).collect()
    return {r.b: r.t for r in b if r.t}, {r.b: r.n for r in b}


def _ratios(target: dict[int, int], raw: dict[int, int]) -> list[float]:
    if not target or not raw:
        return [0.0] * BUCKETS
    nt, nr = sum(target.values()) + SMOOTHING * BUCKETS, sum(raw.values()) + SMOOTHING * BUCKETS
    return [round(math.log((target.get(b, 0) + SMOOTHING) / nt) - math.log((raw.get(b, 0) + SMOOTHING) / nr), 6) for b in range(BUCKETS)]


def _score() -> Column:
    """The mean ratio over the words and pairs, in one walk over the hashes of the words; `r` holds the ratios of the buckets."""
    step = f"(a, x) -> struct(a.s + get(r, {_bucket('x')}) + get(r, {_bucket('a.p', 'x')}) as s, x as p)"
    total = F.expr(f"aggregate(h, struct(double(0) as s, 0L as p), {step}, a -> a.s)")
    return F.when(F.size("h") > 0, F.round(total / (2 * F.size("h")), 6))


#: The number of words in 3-word windows found twice or more. Where no two windows have the same hash it is 0. Else windows
#: are sorted by hash, those with an equal neighbour stay, and what their places cover is added up.
_WINDOWS = "transform(sequence(0, greatest(size(h) - 3, 0)), i -> xxhash64(h[i], get(h, i + 1), get(h, i + 2)))"
_SORTED = "sort_array(transform(g, (x, i) -> struct(x as h, i as i)))"
_REPEATED = "sort_array(transform(filter(s, (x, k) -> get(s, k - 1).h = x.h or get(s, k + 1).h = x.h), x -> x.i))"
_COVERED = "aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 3, least(3, get(p, k + 1) - x))), 0L, (s, x) -> s + x)"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the hashes of the words as `h`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), hashes(text).alias("h"), F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"))
    df = df.withColumns(
        {
            "n_words": F.size("h").cast("long"),
            "n_symbols": (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long"),
            "l": lines,
            "g": F.when(F.size("h") > 3, F.expr(_WINDOWS)),
        }
    )
    df = df.withColumns({"n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"), "s": F.when(F.size(F.array_distinct("g")) < F.size("g"), F.expr(_SORTED))})
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.expr(_REPEATED))).withColumn("n_repeat_words", F.when(F.col("p").isNotNull(), F.expr(_COVERED)).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "h")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()


def bitmaps(ids: DataFrame) -> DataFrame:
    """Exact bitmaps of ids: one row of some 4 KB for each 32,768 neighbouring ids of which any is there."""
    made = ids.select(F.bitmap_bucket_number("doc_id").alias("bucket"), F.bitmap_bit_position("doc_id").alias("bit"))
    return stored(made.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), "trusted")


def with_trusted(docs: DataFrame, marks: DataFrame, small: bool) -> DataFrame:
    """`docs` with trusted. The bitmaps are broadcast where their number, which was counted, is small; else rows meet them by a shuffle."""
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bitmap_bit_position(doc_id) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(bitmap_bit_position(doc_id) % 8 as int)")
    met = docs.join(F.broadcast(marks) if small else marks, F.bitmap_bucket_number("doc_id") == F.col("bucket"), "left")
    return met.withColumn("trusted", F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(1) == 1, F.lit(False))).drop("bucket", "bitmap")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    marks = bitmaps(trusted_ids(labels))
    small = marks.count() <= MOST_BITMAPS
    ratios = F.from_json(F.lit(json.dumps(_ratios(*_counts(with_trusted(plain, marks, small))))), "array<double>")
    scored = features(docs).withColumn("r", ratios).withColumn("llr", _score())
    df = stored(scored.drop("h", "r"), "judged")
    low = with_trusted(df, marks, small).where("trusted").select(F.percentile("llr", PERCENTILE).alias("p")).first().p
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(low if low is not None else 0.0)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
