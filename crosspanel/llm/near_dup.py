"""Near-duplicates by SetSketch (operator 2).

A document's set holds the hashes of its shingles. Documents with equal sets count as one, under the smallest doc_id.
Each set gives REGISTERS registers: the truncated, exponentially spaced minima of as many hash orders. Registers of a
union are the larger ones of both, and equal registers grow with the Jaccard similarity, so bands of ROWS registers find
candidates. For each candidate pair the counts of larger, smaller and equal registers and both set sizes give the
likelihood of every similarity; pairs whose best one is far below the limit go, and all others are confirmed on the
full sets. Confirmed links make components.

A bucket (documents that agree in one band) of up to SMALL_BUCKET sets gives all its pairs. A larger one never does: its
sets meet only its pivot, the set that agrees with most others over all bands. Buckets of one pivot make a group. Where a
group still holds more than one component, the shingles that no other member of such groups has bound what two members
can have in common. So do the differences between members and their pivot: two members differ at least in these, less what
other members share of them. Only pairs outside the group's largest component whose bounds reach the limit are tested,
so no link is left out. Groups are never collected. Where a band, a pivot, a label or one side of the pairs has more than its share of
the rows of a join, those rows are dealt to several tasks (`common.met`).

Defined cases: a null or empty text, or one without words, has the empty set and links with nothing; a text of fewer
words than a shingle has one shingle; equal texts always link; repeated rows give repeated rows; null ids are left out
of linking, keep component null and stay in a deduplicated table; a doc_id on several texts links as each of them, row by
row; an empty table gives an empty table; a very long text has as many shingles as it has; other columns play no part.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches, hot_keys, met, stored, texts_of

SHINGLE, PERCENT = 5, 80
REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65_534
SMALL_BUCKET = 16
BLOOM_BITS = 1 << 26
#: A pair goes without a look at its sets if its likeliest similarity is this far below the limit (over 5 deviations).
SLACK = 0.2
MIX = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


#: Numbers mixed at once, so that they stay in the cache.
BLOCK = 1 << 15


def mixed(h: np.ndarray) -> np.ndarray:
    if h.ndim == 1 and len(h) > BLOCK:
        out = np.empty_like(h)
        for k in range(0, len(h), BLOCK):
            out[k : k + BLOCK] = mixed(h[k : k + BLOCK])
        return out
    x = h >> np.uint64(30)
    x ^= h
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[at]
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mixed(out + MIX) ^ h[k : k + n]
    return np.unique(mixed(out))


def set_number(hashes: np.ndarray) -> int:
    """The number of a set among the nodes: it depends on the set alone, so that a doc_id may stand on several texts."""
    return int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "big", signed=True)


@functools.lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    s = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * MIX)
    return s[:REGISTERS], s[REGISTERS:] | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Register i is floor(1 - log_b(x)) for the least exponential variate x of the set in order i, kept within 0 and TOP + 1."""
    add, factor = _seeds()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        part = hashes[k : k + 2048]
        for i in range(REGISTERS):
            least[i] = min(least[i], ((part ^ add[i]) * factor[i]).min())
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def bands(regs: np.ndarray) -> np.ndarray:
    """For each row of registers one hash a band, which tells the band's place too."""
    parts = regs.reshape(len(regs), -1, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * MIX, parts.shape[:2])
    for k in range(ROWS):
        h = mixed(h + MIX) ^ parts[:, :, k]
    return mixed(h).view(np.int64)


def likeliest(na: np.ndarray, nb: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """For each pair, the similarity of the greatest joint likelihood of its register counts, on a grid."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :]
    p = lambda x: -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    pa_, pb_ = p(u - v * grid), p(v - u * grid)
    possible = (u - v * grid >= -1e-9) & (v - u * grid >= -1e-9)
    same = REGISTERS - larger - smaller
    like = larger[:, None] * np.log(np.maximum(pa_, 1e-12)) + smaller[:, None] * np.log(np.maximum(pb_, 1e-12)) + same[:, None] * np.log(np.maximum(1 - pa_ - pb_, 1e-12))
    return grid[0][np.argmax(np.where(possible, like, -np.inf), axis=1)]


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set, null if empty), id (64 bits of it) and registers."""
    types = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_id": pa.binary(), "id": pa.int64(), "registers": pa.binary()}

    def run(batches):
        for b in batches:
            out = {k: [] for k in types}
            out["doc_id"] = b.column(0)
            for text in b.column(1):
                h = shingle_hashes(text.as_py(), size)
                out["n_shingles"].append(len(h))
                out["set_id"].append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                out["id"].append(set_number(h) if len(h) else None)
                out["registers"].append(registers(h).tobytes() if len(h) else None)
            yield arrow_rows(out, types)

    return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, id long, registers binary")


def _bands_of(nodes: DataFrame) -> DataFrame:
    """band, id and n_shingles: one row for each band of each node. Cheaper made again than stored."""
    types = {"band": pa.int64(), "id": pa.int64(), "n_shingles": pa.int64()}

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = bands(np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, REGISTERS))
                yield arrow_rows({"band": made.ravel(), "id": b.column(0).to_numpy().repeat(made.shape[1]), "n_shingles": b.column(1).to_numpy().repeat(made.shape[1])}, types)

    return nodes.select("id", "n_shingles", "registers").mapInArrow(run, "band long, id long, n_shingles long")


def _perhaps(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id may be among the ids, by a Bloom filter of one hash, so that few other texts are shuffled. It is broadcast: 2,048 bitmaps of 4 KB at most, whatever the number of ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS)) + 1
    bitmaps = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = texts.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)}).join(F.broadcast(bitmaps), "bucket")
    return marked.withColumn("byte", byte).where("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1").select(*texts.columns)


def _sets(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """id and the sorted shingle hashes of the wanted nodes, made from the text of the smallest doc_id of each."""

    def run(batches):
        for b in batches:
            made = [shingle_hashes(t.as_py(), size) for t in b.column(0)]
            yield arrow_rows({"id": [set_number(h) if len(h) else None for h in made], "shingles": [h.tobytes() for h in made]}, {"id": pa.int64(), "shingles": pa.binary()})

    ids = nodes.join(wanted.select("id"), "id", "left_semi").select("doc_id").distinct()
    # an inner join: a semi-join would be moved below the filter's join, and all texts shuffled again
    some = _perhaps(texts_of(docs), ids).join(ids, "doc_id").select("text")
    # other texts under the same doc_ids go by the number of their set
    return some.mapInArrow(run, "id long, shingles binary").join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose likeliest similarity is not far below the limit and whose sizes allow a link. `pairs` is a stored table."""
    a = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    b = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    joined = met(met(pairs, b, "b", hot_keys(pairs, "b"), "a"), a, "a", hot_keys(pairs, "a"), "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    def run(batches):
        for t in batches:
            if t.num_rows:
                ra, rb = (np.frombuffer(b"".join(t.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (3, 5))
                best = likeliest(t.column(2).to_numpy().astype(float), t.column(4).to_numpy().astype(float), (ra > rb).sum(1), (ra < rb).sum(1))
                keep = pa.array(best >= percent / 100 - SLACK)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return joined.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, "a long, b long")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their full sets. `pairs` is a stored table."""

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    a, b = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    joined = met(met(pairs, b, "b", hot_keys(pairs, "b"), "a"), a, "a", hot_keys(pairs, "a"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _shared_sizes(sets: DataFrame, members: DataFrame) -> DataFrame:
    """id, n (its shingles) and m (those that another of the members has too)."""

    def run(batches):
        for t in batches:
            yield arrow_rows({"id": t.column(0), "h": [np.frombuffer(x.as_py(), np.int64) for x in t.column(1)]}, {"id": pa.int64(), "h": pa.list_(pa.int64())})

    rows = sets.join(members, "id", "left_semi").mapInArrow(run, "id long, h array<long>").select("id", F.explode("h").alias("h"))
    owners = rows.groupBy("h").agg(F.min("id").alias("id"), (F.count("*") == 1).cast("long").alias("alone"))
    alone = owners.where("alone = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return sets.join(members, "id", "left_semi").select("id", (F.length("shingles") / 8).cast("long").alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))


def _by_hub(labelled: DataFrame) -> DataFrame:
    """Groups whose pivots are linked become one, under the pivot with most members."""
    homes = labelled.where("id = pivot").select("pivot", F.col("label").alias("home"))
    hubs = labelled.groupBy("pivot").agg(F.count("*").alias("k")).join(homes, "pivot").groupBy("home").agg(F.max_by("pivot", F.struct("k", "pivot")).alias("hub"))
    hub_of = homes.join(hubs, "home").select("pivot", "hub")
    return met(labelled, hub_of, "pivot", hot_keys(labelled, "pivot"), "id").select(F.col("hub").alias("pivot"), "id", "label").distinct()


def _from_pivots(sets: DataFrame, able: DataFrame, hot: DataFrame | None) -> DataFrame:
    """`able` with d (hashes that only one of the member and its pivot has) and s (those of them that are so for another member of the group too)."""

    def run(batches):
        for t in batches:
            x, p = (([np.frombuffer(v.as_py(), np.int64) for v in t.column(k)]) for k in (2, 3))
            apart = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(x, p)]
            yield arrow_rows({"pivot": t.column(0), "id": t.column(1), "h": apart}, {"pivot": pa.int64(), "id": pa.int64(), "h": pa.list_(pa.int64())})

    own = able.select("pivot", "id").join(sets.select("id", F.col("shingles").alias("x")), "id")
    both = met(own, sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("p")), "pivot", hot, "id")
    rows = both.select("pivot", "id", "x", "p").mapInArrow(run, "pivot long, id long, h array<long>").select("pivot", "id", F.explode("h").alias("h"))
    owners = rows.groupBy("pivot", "h").agg(F.min("id").alias("id"), F.count("*").alias("k"))
    alone = owners.where("k = 1").groupBy("pivot", "id").agg(F.count("*").alias("alone"))
    sizes = rows.groupBy("pivot", "id").agg(F.count("*").alias("d"))
    zero = F.lit(0).cast("long")
    d, lone = F.coalesce("d", zero), F.coalesce("alone", zero)
    return able.join(sizes, ["pivot", "id"], "left").join(alone, ["pivot", "id"], "left").select(*able.columns, d.alias("d"), (d - lone).alias("s"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and label, the smallest id reachable over the links: labels spread to neighbours and then jump to their label's label."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    hot = hot_keys(both, "b")
    while True:
        near = met(both, labels.select(F.col("id").alias("b"), "label"), "b", hot, "a").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = stored(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "spread")
        # a label is an id with links, so it has a label of its own
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = stored(met(spread, jump, "label", hot_keys(spread, "label"), "id").select("id", "old", F.least("label", "further").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old != label").isEmpty():
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _links(docs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    rows = _bands_of(nodes)
    sizes = stored(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    hot = hot_keys(sizes, "band", nodes.count() * (REGISTERS // ROWS), each="n")
    members = stored(met(rows, sizes, "band", hot, "id").select("band", "id", "n", "n_shingles"), "members")
    small, large = members.where(F.col("n") <= SMALL_BUCKET), members.where(F.col("n") > SMALL_BUCKET)
    gathered = small.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("id", "n_shingles"))).alias("ids"))  # SMALL_BUCKET ids at most
    fits = f"y -> 100 * x.n_shingles >= {percent} * y.n_shingles and 100 * y.n_shingles >= {percent} * x.n_shingles"
    pairs = gathered.select(F.explode(F.expr(f"flatten(transform(ids, (x, i) -> transform(filter(slice(ids, i + 2, size(ids)), {fits}), y -> struct(x.id as a, y.id as b))))")).alias("p")).select("p.a", "p.b")
    ranked = large.join(large.groupBy("id").agg(F.sum("n").alias("degree")), "id")
    pivots = ranked.groupBy("band").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"))
    crowded = sizes.where(F.col("n") > SMALL_BUCKET)
    hot = hot_keys(crowded, "band", crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], each="n")  # of the rows of large bands alone
    groups = stored(met(large, pivots, "band", hot, "id").select("pivot", "id").distinct(), "groups")
    stars = groups.where("id != pivot").select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b"))

    some = stored(_estimated(stored(pairs.union(stars).distinct(), "candidates"), nodes, percent), "pairs")
    wanted = some.select(F.explode(F.array("a", "b")).alias("id")).union(groups.select("id")).distinct()
    sets = stored(_sets(docs, wanted, nodes, size), "sets")
    links = stored(_confirmed(sets, some, percent), "confirmed")

    labelled = _by_hub(stored(groups.join(components(groups.select("id").distinct(), links), "id"), "labelled"))
    labelled = stored(labelled, "labelled")
    split = labelled.groupBy("pivot").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("pivot")
    hot = hot_keys(labelled, "pivot")
    open_ = stored(met(labelled, split, "pivot", hot, "id").select("pivot", "id", "label"), "open")
    if open_.isEmpty():
        return links
    # a member links with another only if what others have too is large enough a part of it
    able = _shared_sizes(sets, open_.select("id").distinct()).where(100 * F.col("m") >= percent * F.col("n"))
    able = open_.join(able, "id")
    counts = open_.groupBy("pivot", "label").agg(F.count("*").alias("k"))
    most = counts.groupBy("pivot").agg(F.max_by("label", F.struct("k", "label")).alias("most"))
    # and two members differ in all in which both differ from the pivot, but for what they have in common there
    able = stored(_from_pivots(sets, stored(able, "able"), hot), "able")
    rest = met(able, most, "pivot", hot, "id").where("label != most").select("pivot", F.col("id").alias("other"), F.col("label").alias("its"), *(F.col(c).alias(c + "2") for c in "nmds"))
    common, apart = F.least("m", "m2"), F.col("d") + F.col("d2") - 2 * F.least("s", "s2")
    n = F.col("n") + F.col("n2")
    within = (100 * common >= percent * (n - common)) & ((100 + percent) * apart <= (100 - percent) * n)
    # sizes of linked sets differ by less than a step of the bands, so a pair stands in the same or the next band
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9)
    able = able.withColumn("size_band", step)
    rest = rest.withColumn("band2", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.log(F.col("n2").cast("double")) / math.log(100 / percent) + 1e-9) + k)))
    pairs = able.join(rest, (able["pivot"] == rest["pivot"]) & (F.col("size_band") == F.col("band2")) & (F.col("label") != F.col("its")) & within).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    more = stored(_estimated(stored(pairs.distinct(), "candidates"), nodes, percent), "pairs")
    return links.union(stored(_confirmed(sets, more, percent), "confirmed"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id = component_id)."""
    bounded_batches(docs.sparkSession)
    base = stored(sketches(docs, size), "sketches")
    # equal sets count once; registers are a function of the set, so any of them will do
    nodes = base.where("set_id is not null and doc_id is not null").groupBy("set_id", "id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    nodes = stored(nodes, "nodes")
    labels = components(nodes, _links(docs, nodes, percent, size))
    classes = nodes.select("set_id", "id", "doc_id").join(labels, "id")
    least = classes.groupBy("label").agg(F.min("doc_id").alias("least"))
    classes = classes.join(least, "label").select("set_id", "least")
    linkable = base.where("set_id is not null and doc_id is not null").select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    # rows without words or without an id link with nothing
    alone = base.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linkable.select("doc_id", "n_shingles", F.col("least").alias("component_id")).union(alone)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs` with its columns, of each component the document with the smallest doc_id; rows without a doc_id stay, as do those with a doc_id that stands for a component by another of its texts."""
    key = "gone_id"
    while key in docs.columns:
        key = f"_{key}"
    judged = near_duplicates(docs, size, percent).groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("kept"))
    gone = judged.where("not kept").select(key)
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(key), "left_anti")
