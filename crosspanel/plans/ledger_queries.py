"""Queries of the ledger of books, its checks, post-mortems, gates and paper trades, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import wide
from crosspanel.plans import book_queries as bk
from crosspanel.plans import health_queries as hq
from crosspanel.plans.book_queries import R6, WEEKS, r6
from crosspanel.plans.factor_queries import LAGS
from crosspanel.plans.health_queries import HEALTH
from crosspanel.sources import panel as p

REVEAL_DAYS, LAST_WEEKS, LEAST_SCORED, LEAST_PATTERN, LEAST_NAMES = 31, 13, 8, 8, 5
START, MOST_OPEN, PAUSE, STREAK = 1_000_000_000.0, 10, 0.10, 3
STOP, FALL, THIN, CROWDED = 0.10, -0.15, 0.10, 0.30


def committed(spark, d) -> DataFrame:
    """variant, as_of, seq, file, content and sha256 of each week's book; a book has ten codes at most."""
    content = F.array_join(F.sort_array(F.collect_list(F.format_string("%06d", F.col("code")))), ",")
    x = bk.books(spark, d).groupBy("variant", F.col("date").alias("as_of")).agg(content.alias("content"))
    seq = F.row_number().over(Window.partitionBy("variant").orderBy("as_of"))
    return x.select("variant", "as_of", seq.alias("seq"), F.concat_ws("-", "variant", F.col("as_of").cast("string")).alias("file"), "content", F.sha2("content", 256).alias("sha256"))


def chained(entries: DataFrame) -> DataFrame:
    """`entries` with prev_hash and entry_hash: each hash covers the one before, so a variant's entries, one a week, are folded in order."""
    one = F.struct("seq", "as_of", "file", "content", "sha256")
    lists = entries.groupBy("variant").agg(F.sort_array(F.collect_list(one)).alias("list"))
    step = """(a, x) -> array_append(a, named_struct('seq', x.seq, 'as_of', x.as_of, 'file', x.file, 'content', x.content, 'sha256', x.sha256,
        'prev_hash', if(size(a) = 0, 'genesis', element_at(a, -1).entry_hash),
        'entry_hash', sha2(concat_ws('|', if(size(a) = 0, 'genesis', element_at(a, -1).entry_hash), x.sha256, cast(x.as_of as string), variant), 256)))"""
    empty = "cast(array() as array<struct<seq: int, as_of: date, file: string, content: string, sha256: string, prev_hash: string, entry_hash: string>>)"
    return lists.select("variant", F.inline(F.expr(f"aggregate(list, {empty}, {step})")))


def tampered(spark, d) -> DataFrame:
    """The ledger after someone changed contents, fingerprints and links in places."""
    x = chained(committed(spark, d))
    return x.withColumns(
        {
            "content": F.when(F.col("seq") % 50 == 17, F.concat("content", F.lit(",999999"))).otherwise(F.col("content")),
            "sha256": F.when(F.col("seq") % 60 == 29, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")),
            "prev_hash": F.when(F.col("seq") % 70 == 30, F.lit("elsewhere")).otherwise(F.col("prev_hash")),
        }
    )


def verified(ledger: DataFrame) -> DataFrame:
    """By entry whether the link, the entry's own hash and the content's fingerprint hold."""
    before = F.lag("entry_hash", 1, "genesis").over(Window.partitionBy("variant").orderBy("seq"))
    own = F.sha2(F.concat_ws("|", "prev_hash", "sha256", F.col("as_of").cast("string"), "variant"), 256)
    return ledger.select("variant", "seq", "file", (F.col("prev_hash") == before).alias("linked"), (F.col("entry_hash") == own).alias("own"), (F.sha2("content", 256) == F.col("sha256")).alias("unchanged"))


def w60_chain_check(spark, d):
    return verified(tampered(spark, d))


def x9_file_verify(spark, d):
    """Entries whose content no longer has the committed fingerprint, and how many entries hold."""
    x = verified(tampered(spark, d))
    return x.groupBy("variant").agg(F.count("*").alias("files"), F.count_if("unchanged").alias("good"), F.min(F.when(~F.col("unchanged"), F.col("file"))).alias("first_bad"))


def today(spark, d) -> DataFrame:
    return p.bars(spark, d).agg(F.max("date").alias("now"))


def revealed(spark, d) -> DataFrame:
    """Entries old enough to be shown: those of the last month are not."""
    x = committed(spark, d).join(F.broadcast(today(spark, d)), how="cross")  # one row
    return x.where(F.date_add("as_of", REVEAL_DAYS) <= F.col("now")).drop("now")


def x10_reveal(spark, d):
    """Files due to be shown that were not shown before, when every third was."""
    done = committed(spark, d).where("seq % 3 = 0").select("file")
    return revealed(spark, d).join(done, "file", "left_anti").select("variant", "as_of", "file")


def u4_completeness(spark, d):
    """Whether the files shown cover all commitments, by variant; what is missing is counted."""
    shown = revealed(spark, d).select("variant", "file")
    missing = committed(spark, d).join(shown, ["variant", "file"], "left_anti").groupBy("variant").agg(F.count("*").alias("missing"))
    x = committed(spark, d).groupBy("variant").agg(F.count("*").alias("files")).join(missing, "variant", "left")
    return x.select("variant", "files", F.coalesce("missing", F.lit(0).cast("long")).alias("missing"), F.col("missing").isNull().alias("complete"))


def ranked_book(spark, d) -> DataFrame:
    """variant top: date, code, p, position, in_book, r, and the week's number of names n."""
    x = wide.day_places(p.bars(spark, d).select("date", "code", "value"), "value").select("date", "code", "p", "position", "n")
    return x.withColumn("in_book", F.col("position") <= bk.SLOTS).join(bk.ahead(spark, d), ["date", "code"], "left")


def t6_ranked_list(spark, d):
    """Every code's position in each week's list and whether it stands in the book: a code's rows are its history."""
    return ranked_book(spark, d).select("date", "code", "position", "in_book", R6(F.col("p")).alias("p"))


#: What a centred rank of each column adds.
WEIGHTS = {"value": 1.0, "volume": 0.5, "high": -0.4, "low": 0.3, "close": -0.2, "open": 0.1}


def side_by_side(spark, d) -> DataFrame:
    """date, code and for each feature its contribution: centred ranks times fixed weights."""
    x = wide.day_ranks(p.bars(spark, d), list(WEIGHTS))
    return x.select("date", "code", *(R6(F.col(c) * w).alias(c) for c, w in WEIGHTS.items()))


def contributions(spark, d) -> DataFrame:
    """date, code, feature and contribution."""
    return side_by_side(spark, d).unpivot(["date", "code"], list(WEIGHTS), "feature", "contribution")


def t5_top_reasons(spark, d):
    """The five features that move each code of a week most. They stand in one row, so they are put in order there."""
    one = lambda c: F.struct(F.coalesce(-F.abs(c), F.lit(1.0)).alias("order"), F.lit(c).alias("feature"), F.col(c).alias("contribution"))
    first = F.slice(F.sort_array(F.array(*map(one, WEIGHTS))), 1, 5)
    x = side_by_side(spark, d).select("date", "code", F.posexplode(first).alias("k", "one"))
    return x.select("date", "code", "one.feature", "one.contribution", (F.col("k") + 1).alias("k"))


def sector_effects(x: DataFrame) -> DataFrame:
    """Allocation and selection by date and sector, for names with a return: `x` has date, code, sector, in_book and r."""
    x = x.where("r is not null")
    held = F.count_if("in_book")
    day = x.groupBy("date").agg(F.count("*").alias("n"), held.alias("nb"), F.avg("r").alias("r_all")).where("nb > 0")
    per = x.groupBy("date", "sector").agg(F.count("*").alias("ns"), held.alias("names"), F.avg("r").alias("sector_return"), F.avg(F.when(F.col("in_book"), F.col("r"))).alias("r_book"))
    per = per.join(day, "date").withColumns({"book_weight": F.col("names") / F.col("nb"), "universe_weight": F.col("ns") / F.col("n")})
    allocation = (F.col("book_weight") - F.col("universe_weight")) * (F.col("sector_return") - F.col("r_all"))
    selection = F.col("book_weight") * (F.coalesce("r_book", "sector_return") - F.col("sector_return"))
    return per.withColumns({"allocation": allocation, "selection": selection, "total": allocation + selection})


def with_sector(x: DataFrame, spark, d) -> DataFrame:
    """Every fifth supplier's sector is not known."""
    known = hq.sectors(spark, d).where("code % 5 != 4")
    return x.join(known, "code", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def a46_attribution(spark, d):
    x = sector_effects(with_sector(ranked_book(spark, d), spark, d))
    return x.select("date", "sector", "names", *(R6(F.col(c)).alias(c) for c in ("book_weight", "universe_weight", "sector_return", "allocation", "selection", "total")))


def j15_sector_attach(spark, d):
    """Codes by sector, unknown ones as such."""
    return with_sector(p.bars(spark, d), spark, d).groupBy("sector").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("weeks"))


def postmortem(spark, d) -> DataFrame:
    """One row a week: returns, rank coefficient, top less bottom, best and worst three, and the three features used most."""
    x = ranked_book(spark, d)
    some = x.where("r is not null")
    day = Window.partitionBy("date")
    ic = wide.day_coefficients(some, ["p"], "r", 1).select("date", F.col("ic").alias("rank_ic"))
    mean = lambda e: F.avg(F.when(e, F.col("r")))
    sums = x.groupBy("date").agg(mean(F.col("in_book")).alias("book"), F.avg("r").alias("equal"), F.count("r").alias("names"), F.count_if("in_book").alias("size"), (mean(F.col("position") <= bk.SLOTS) - mean(F.col("position") > F.col("n") - bk.SLOTS)).alias("top_less_bottom"))
    picks = some.where("in_book").withColumns({"up": F.row_number().over(day.orderBy(F.desc("r"), "code")), "down": F.row_number().over(day.orderBy("r", "code"))})
    three = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(k) <= 3, F.struct(k, "code")))), lambda s: s["code"].cast("string")), ",")
    best = picks.groupBy("date").agg(three("up").alias("best"), three("down").alias("worst"))
    why = contributions(spark, d).join(x.where("in_book").select("date", "code", "r"), ["date", "code"])
    used = why.groupBy("date", "feature").agg(F.sum(F.abs("contribution")).alias("size"), F.count_if(F.col("contribution") > 0).alias("stocks"), F.avg(F.when(F.col("contribution") > 0, F.col("r"))).alias("favoured"))
    used = used.withColumn("k", F.row_number().over(day.orderBy(F.desc(F.round("size", 6)), "feature"))).where("k <= 3")
    reasons = used.groupBy("date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "feature", "stocks"))), lambda s: F.concat_ws(":", s["feature"], s["stocks"].cast("string"))), ",").alias("reasons"), F.max_by("favoured", -F.col("k")).alias("favoured_return"))
    made = sums.where(F.col("names") >= LEAST_NAMES).join(ic, "date", "left").withColumn("rank_ic", F.coalesce("rank_ic", F.lit(float("nan")))).join(best, "date", "left").join(reasons, "date", "left").join(bk.market(spark, d), "date", "left")
    return made.where("book is not null and bench is not null")


def a47_postmortem(spark, d):
    x = postmortem(spark, d)
    return x.select("date", "names", "size", "best", "worst", "reasons", (F.col("book") > F.col("bench")).alias("beat_index"), (F.round(F.col("book") - F.col("equal"), 9) > 0).alias("beat_equal"), *(R6(F.col(c)).alias(c) for c in ("book", "equal", "bench", "rank_ic", "top_less_bottom", "favoured_return")))


def percent(c: Column) -> Column:
    return F.format_string("%+.1f%%", c.cast("double") * 100)


def x8_sentences(spark, d):
    """What the numbers of a week say, in words."""
    lead = F.when(F.col("book") > F.col("bench"), "The book beat the index").otherwise("The book fell behind the index")
    ranking = F.when(F.col("rank_ic") > 0.02, "the ranking was right more often than not").when(F.col("rank_ic") < -0.02, "the ranking was wrong more often than not").otherwise("the ranking said little")
    side = F.when(F.col("top_less_bottom") > 0, "its top names did better than its last ones")
    return postmortem(spark, d).select("date", F.array_join(F.array_compact(F.array(lead, ranking, side)), "; ").alias("sentence"))


def f16_report_numbers(spark, d):
    """Signed percents and shares of a report's rows; halves beyond the shown digit never decide, as numbers are rounded first."""
    x = postmortem(spark, d)
    tidy = lambda c: F.round(F.col(c), 6)
    return x.select("date", F.format_string("%+.1f%%", F.round(tidy("book") * 1000) / 10 + 0.0).alias("book"), F.format_string("%d of %d", "size", "names").alias("names"), F.format_string("%.3f", F.round(F.round(F.col("rank_ic"), 6) * 1000) / 1000 + 0.0).alias("rank_ic"))


def a48_patterns(spark, d):
    """Weeks, mean excess and hits by the market's mood and by its zone, of groups with eight weeks or more."""
    x = postmortem(spark, d).join(hq.health(spark, d), "date").withColumn("excess", F.col("book") - F.col("bench"))
    x = x.withColumns({"mood": F.when(F.col("bench") >= 0, "rising").otherwise("falling"), "variant": F.lit("top")})
    x.createOrReplaceTempView("crosspanel_patterns")
    groups = spark.sql("select variant, mood, zone, count(*) weeks, avg(excess) excess, avg(double(excess > 0)) hits, avg(rank_ic) rank_ic from crosspanel_patterns group by grouping sets ((variant, mood), (variant, zone))")
    return groups.where(F.col("weeks") >= LEAST_PATTERN).select("variant", "mood", "zone", "weeks", *(R6(F.col(c)).alias(c) for c in ("excess", "hits", "rank_ic")))


def scores(spark, d) -> DataFrame:
    """By revealed entry the returns of the book, the index and all names, and which are beaten."""
    r = bk.ahead(spark, d).where("r is not null")
    book = bk.books(spark, d).join(r, ["date", "code"]).groupBy("variant", "date").agg(F.count("*").alias("stocks"), F.avg("r").alias("book"))
    equal = r.groupBy("date").agg(F.avg("r").alias("equal"))
    x = revealed(spark, d).select("variant", F.col("as_of").alias("date")).join(book, ["variant", "date"]).join(equal, "date").join(bk.market(spark, d), "date").where("bench is not null")
    return x.withColumn("excess", F.col("book") - F.col("bench"))


def a49_ledger_scores(spark, d):
    return scores(spark, d).select("variant", "date", "stocks", *(R6(F.col(c)).alias(c) for c in ("book", "equal", "bench", "excess")), (F.col("book") > F.col("bench")).alias("beat_index"), (F.round(F.col("book") - F.col("equal"), 9) > 0).alias("beat_equal"))


def a50_drift_watch(spark, d):
    """Of the last thirteen scored weeks of each variant: hits, yearly excess, and whether to warn."""
    x = scores(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("date")))).where(F.col("k") <= LAST_WEEKS)
    x = x.groupBy("variant").agg(F.count("*").alias("weeks"), F.avg((F.col("book") > F.col("bench")).cast("double")).alias("hits"), (F.avg("excess") * 52).alias("excess_ann"))
    warn = (F.col("weeks") >= LEAST_SCORED) & (F.col("hits") < 0.4) & (F.col("excess_ann") < 0)
    return x.select("variant", "weeks", R6(F.col("hits")).alias("hits"), R6(F.col("excess_ann")).alias("excess_ann"), F.when(warn, "warning").otherwise("ok").alias("status"))


def a51_data_gate(spark, d):
    """Each week as the latest: names, missing ones, large moves of five weeks and the gap before it, and what they mean."""
    x = p.dense_bars(spark, d).withColumn("r", F.abs(F.col("close") / F.last("close", ignorenulls=True).over(f.by_code().rowsBetween(Window.unboundedPreceding, -1)) - 1))
    day = x.groupBy("date").agg(F.count("close").alias("names"), F.avg(F.col("close").isNull().cast("double")).alias("missing"), F.count_if(F.col("r") > 0.25).alias("moves")).withColumn("series", F.lit("all"))
    w = Window.partitionBy("series").orderBy("date")
    day = day.withColumns({"big": F.sum("moves").over(w.rowsBetween(-4, 0)), "age": F.datediff(F.lead("date").over(w), "date")})
    stop = (F.col("names") < 5) | (F.col("missing") > 0.5) | (F.col("age") > 14)
    warning = (F.col("missing") > 0.2) | (F.col("big") > 0) | (F.col("age") > 7)
    return day.select("date", "names", R6(F.col("missing")).alias("missing"), "big", F.when(stop, "stop").when(warning, "warning").otherwise("ok").alias("status"))


def risk(spark, d) -> DataFrame:
    """Flags of each name in each week's book: surveillance, locked at one price, a fall over five weeks, thin trading."""
    by = f.by_code()
    x = p.dense_bars(spark, d).select("date", "code", "close", (F.col("close") / F.lag("close", 5).over(by) - 1).alias("r5"), F.coalesce((F.col("high") == F.col("low")) & (F.abs(F.col("close") / F.lag("close").over(by) - 1) >= 0.019), F.lit(False)).alias("locked"), F.percentile("value", 0.5).over(f.by_code(20)).alias("traded"))
    cut = x.where("close is not null").groupBy("date").agg(F.percentile("traded", THIN).alias("cut"))
    x = x.join(bk.books(spark, d).where("variant = 'top'").select("date", "code"), ["date", "code"]).join(cut, "date")
    watched = p.read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("code"), F.lit(True).alias("watched"))
    x = x.join(watched, "code", "left")
    flags = F.array_compact(F.array(F.when(F.col("watched"), "surveillance"), F.when(F.col("locked"), "locked"), F.when(F.col("r5") <= FALL, "fell"), F.when(F.col("traded") < F.col("cut"), "thin")))
    return x.select("date", "code", flags.alias("flags"))


def a52_risk_flags(spark, d):
    return risk(spark, d).where(F.size("flags") > 0).select("date", "code", F.array_join("flags", ",").alias("flags"))


def a52_crowding(spark, d):
    """Sectors that hold more than three tenths of a week's book; unknown ones do not count."""
    x = with_sector(bk.books(spark, d).where("variant = 'top'"), spark, d)
    n = F.count("*").over(Window.partitionBy("date"))
    per = x.withColumn("n", n).groupBy("date", "sector").agg((F.count("*") / F.first("n")).alias("share"))
    return per.where((F.col("sector") != "Unknown") & (F.col("share") > CROWDED)).select("date", "sector", R6(F.col("share")).alias("share"))


def prices(spark, d) -> DataFrame:
    """date, code, t and px: the smoothed close, carried over gaps."""
    smooth = F.when(F.col("close").isNotNull(), F.avg("close").over(f.by_code(8)))
    x = p.dense_bars(spark, d).withColumn("smooth", smooth)
    return x.select("date", "code", "t", F.last("smooth", ignorenulls=True).over(f.by_code().rowsBetween(Window.unboundedPreceding, 0)).alias("px"))


def trades(spark, d) -> DataFrame:
    """Orders as paper trades: id, code, status, opened, closed, amount, in_book, plan_weeks, entry and exit price and index, all as of the last week not after the day."""
    codes = p.read(spark, d, "supplier").agg(F.count("*").alias("m"))
    o = p.read(spark, d, "orders").join(F.broadcast(codes), how="cross")  # one row
    o = o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("m")).alias("code"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("status"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("opened"),
        F.col("o_totalprice").alias("amount"), (F.col("o_orderkey") % 2 == 0).alias("in_book"), (F.col("o_orderkey") % 30).cast("int").alias("plan_weeks"),
    ).withColumn("closed", F.when(F.col("status") == "closed", F.date_add("opened", (7 * (1 + F.col("id") % 20)).cast("int"))))
    px = prices(spark, d).where("px is not null").select("date", "code", "px")
    level = p.benchmark(p.bars(spark, d)).select("date", "level")
    o = o.join(px.select(F.col("date").alias("opened"), "code", F.col("px").alias("entry_price")), ["opened", "code"]).join(level.select(F.col("date").alias("opened"), F.col("level").alias("entry_index")), "opened")
    now = px.groupBy("code").agg(F.max("date").alias("last"))
    o = o.join(now, "code").withColumn("day", F.coalesce("closed", "last")).where("day <= last")
    return o.join(px.select(F.col("date").alias("day"), "code", F.col("px").alias("price")), ["day", "code"]).join(level.select(F.col("date").alias("day"), F.col("level").alias("index")), "day").drop("last")


def marked(spark, d) -> DataFrame:
    x = trades(spark, d).withColumns({"ret": F.col("price") / F.col("entry_price") - 1, "days": F.datediff("day", "opened")})
    return x.withColumns({"vs_index": F.col("ret") - (F.col("index") / F.col("entry_index") - 1), "pnl": F.col("amount") * F.col("ret")})


def a53_paper_marks(spark, d):
    """Each trade at its last price: return, against the index, gain, days, and open ones' flags for stop and planned time."""
    is_open = F.col("status") == "open"
    flags = F.array_compact(F.array(F.when(is_open & (F.col("ret") <= -STOP), "stop"), F.when(is_open & (F.col("plan_weeks") > 0) & (F.col("days") >= 7 * F.col("plan_weeks")), "planned time")))
    return marked(spark, d).select("id", "code", "status", "days", *(R6(F.col(c)).alias(c) for c in ("ret", "vs_index")), F.round("pnl", 2).alias("pnl"), F.array_join(flags, ",").alias("flags"))


def a54_paper_digest(spark, d):
    """Closed trades in all and by source: how many win, means, best and worst."""
    x = marked(spark, d).where("status = 'closed'").select("ret", "vs_index", F.explode(F.array(F.lit("all"), F.when(F.col("in_book"), "in the book").otherwise("not in the book"))).alias("source"))
    win = F.col("ret") > 0
    made = {
        "win_rate": F.avg(win.cast("double")), "avg_return": F.avg("ret"), "avg_vs_index": F.avg("vs_index"), "beat_index_rate": F.avg((F.col("vs_index") > 0).cast("double")), "avg_win": F.avg(F.when(win, F.col("ret"))),
        "avg_loss": F.avg(F.when(~win, F.col("ret"))), "best": F.max("ret"), "worst": F.min("ret"),
    }
    return x.groupBy("source").agg(F.count("*").alias("closed"), *(R6(e).alias(k) for k, e in made.items()))


def account(spark, d) -> DataFrame:
    """date and value of the account: gains of live trades at the last price and gains taken. Trades become steps of units
    and cost by code and week, which running sums add up, so that no trade is repeated for its weeks."""
    t = trades(spark, d)
    units = F.col("amount") / F.col("entry_price")
    zero = F.lit(0.0)
    steps = t.select("code", F.col("opened").alias("date"), units.alias("units"), F.col("amount").alias("cost"), zero.alias("taken"))
    gain = F.col("amount") * (F.col("price") / F.col("entry_price") - 1)
    ends = t.where("status = 'closed'").select("code", F.date_add("closed", 7).alias("date"), (-units).alias("units"), (-F.col("amount")).alias("cost"), gain.alias("taken"))
    steps = steps.union(ends).groupBy("code", "date").agg(*(F.sum(c).alias(c) for c in ("units", "cost", "taken")))
    run = f.by_code().rowsBetween(Window.unboundedPreceding, 0)
    x = prices(spark, d).join(steps, ["code", "date"], "left").withColumns({c: F.sum(F.coalesce(c, zero)).over(run) for c in ("units", "cost", "taken")})
    value = F.sum(F.coalesce(F.col("units") * F.col("px"), zero) - F.col("cost") + F.col("taken"))
    return x.groupBy("date").agg((value + START).alias("value")).withColumn("series", F.lit("paper"))


def w61_account_value(spark, d):
    w = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = account(spark, d)
    return x.select("date", F.round("value", 0).alias("value"), R6(F.col("value") / F.max("value").over(w) - 1).alias("drawdown"))


def a55_position_gate(spark, d):
    """Whether a new trade may open: too many open ones, an account too far below its height, or a run of losses at the end."""
    open_n = trades(spark, d).agg(F.count_if(F.col("status") == "open").alias("open"))
    value = account(spark, d).agg((F.max_by("value", "date") / F.max("value") - 1).alias("drawdown"))
    closed = trades(spark, d).where("status = 'closed'").withColumn("loss", F.col("price") < F.col("entry_price"))
    # the last win is found by one maximum, so the losses after it are counted without an order of all trades
    last = closed.where("not loss").agg(F.max(F.struct("closed", "id")).alias("last"))
    streak = closed.join(F.broadcast(last), how="cross").where(F.col("last").isNull() | (F.struct("closed", "id") > F.col("last"))).agg(F.count("*").alias("streak"))  # one row
    reasons = F.array_compact(F.array(F.when(F.col("open") >= MOST_OPEN, "too many open"), F.when(F.col("drawdown") <= -PAUSE, "drawdown"), F.when(F.col("streak") >= STREAK, "losing streak")))
    x = open_n.join(value, how="cross").join(streak, how="cross")  # one row each
    return x.select("open", R6(F.col("drawdown")).alias("drawdown"), "streak", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("may_open"))


def t2_top_fifth(spark, d):
    """Members in the top fifth by rank that can be bought: those with volume in the next week."""
    x = p.dense_bars(spark, d).withColumn("next", F.lead("volume").over(f.by_code())).where("close is not null")
    return x.withColumn("q", f.cs_rank(F.col("close"))).where("q > 0.8 and next > 0").select("date", "code", R6(F.col("q")).alias("q"))


def t4_extremes(spark, d):
    """The three best and the three worst weeks of each code by return."""
    w = Window.partitionBy("code")
    x = bk.ahead(spark, d).where("r is not null").withColumns({"best": F.row_number().over(w.orderBy(F.desc("r"), "date")), "worst": F.row_number().over(w.orderBy("r", "date"))})
    return x.where("best <= 3 or worst <= 3").select("code", "date", R6(F.col("r")).alias("r"), "best", "worst")


CALLS = (
    w60_chain_check, x9_file_verify, x10_reveal, u4_completeness, t6_ranked_list, t5_top_reasons, a46_attribution, j15_sector_attach, a47_postmortem, x8_sentences, f16_report_numbers, a48_patterns,
    a49_ledger_scores, a50_drift_watch, a51_data_gate, a52_risk_flags, a52_crowding, a53_paper_marks, a54_paper_digest, w61_account_value, a55_position_gate, t2_top_fifth, t4_extremes,
)
QUERIES = {c.__name__: c for c in CALLS}

BASE = WEEKS.replace("WITH bars", "WITH RECURSIVE bars", 1)
LEDGER = f"""{BASE}, com AS (SELECT variant, date AS as_of, CAST(row_number() OVER (PARTITION BY variant ORDER BY date) AS INTEGER) AS seq, variant || '-' || date AS file, content, sha256(content) AS sha FROM (SELECT variant, date, string_agg(lpad(CAST(code AS VARCHAR), 6, '0'), ',' ORDER BY code) AS content FROM book GROUP BY 1, 2)),
ch AS (SELECT variant, as_of, seq, file, content, sha, 'genesis' AS prev, sha256('genesis|' || sha || '|' || as_of || '|' || variant) AS entry FROM com WHERE seq = 1
 UNION ALL SELECT c.variant, c.as_of, c.seq, c.file, c.content, c.sha, ch.entry, sha256(ch.entry || '|' || c.sha || '|' || c.as_of || '|' || c.variant) FROM ch JOIN com c ON c.variant = ch.variant AND c.seq = ch.seq + 1),
ta AS (SELECT variant, as_of, seq, file, CASE WHEN seq % 50 = 17 THEN content || ',999999' ELSE content END AS content, CASE WHEN seq % 60 = 29 THEN sha256('other') ELSE sha END AS sha, CASE WHEN seq % 70 = 30 THEN 'elsewhere' ELSE prev END AS prev, entry FROM ch),
ve AS (SELECT variant, seq, file, prev = lag(entry, 1, 'genesis') OVER (PARTITION BY variant ORDER BY seq) AS linked, entry = sha256(prev || '|' || sha || '|' || as_of || '|' || variant) AS own, sha256(content) = sha AS unchanged FROM ta),
re AS (SELECT * FROM com WHERE as_of + 31 <= (SELECT max(date) FROM bars))"""
RB = f"{WEEKS}, rb AS (SELECT px.date, px.code, p, k AS position, count(*) OVER (PARTITION BY px.date) AS n, k <= 10 AS in_book, r FROM px LEFT JOIN ahead a ON a.date = px.date AND a.code = px.code)"
_W = {"value": 1.0, "volume": 0.5, "high": -0.4, "low": 0.3, "close": -0.2, "open": 0.1}


def _contribution(c: str, w: float) -> str:
    return r6(f"((rank() OVER (PARTITION BY date ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5) * {w}")


CON = f"con AS (SELECT date, code, unnest([{', '.join(repr(k) for k in _W)}]) AS feature, unnest([{', '.join(_contribution(k, w) for k, w in _W.items())}]) AS contribution FROM bars)"
SECTOR = "sk AS (SELECT s_suppkey AS code, r_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 5 != 4)"
PM = f"""{RB}, {CON}, so AS (SELECT * FROM rb WHERE r IS NOT NULL),
ic AS (SELECT date, corr(a, c) AS rank_ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0 AS c FROM so) GROUP BY 1),
sm AS (SELECT date, avg(CASE WHEN in_book THEN r END) AS book, avg(r) AS equal, count(r) AS names, count(CASE WHEN in_book THEN 1 END) AS size, avg(CASE WHEN position <= 10 THEN r END) - avg(CASE WHEN position > n - 10 THEN r END) AS top_less_bottom FROM rb GROUP BY 1 HAVING count(r) >= 5),
pk AS (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY r DESC, code) AS up, row_number() OVER (PARTITION BY date ORDER BY r, code) AS down FROM so WHERE in_book),
be AS (SELECT date, string_agg(CASE WHEN up <= 3 THEN code::VARCHAR END, ',' ORDER BY up) AS best, string_agg(CASE WHEN down <= 3 THEN code::VARCHAR END, ',' ORDER BY down) AS worst FROM pk GROUP BY 1),
us AS (SELECT c.date, feature, sum(abs(contribution)) AS size, count(CASE WHEN contribution > 0 THEN 1 END) AS stocks, avg(CASE WHEN contribution > 0 THEN r END) AS favoured FROM con c JOIN rb ON rb.date = c.date AND rb.code = c.code WHERE in_book GROUP BY 1, 2),
uk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(size, 6) DESC, feature) AS k FROM us QUALIFY k <= 3),
rs AS (SELECT date, string_agg(feature || ':' || stocks, ',' ORDER BY k) AS reasons, max(CASE WHEN k = 1 THEN favoured END) AS favoured_return FROM uk GROUP BY 1),
pm AS (SELECT sm.*, rank_ic, best, worst, reasons, favoured_return, bench FROM sm JOIN ic USING (date) LEFT JOIN be USING (date) LEFT JOIN rs USING (date) LEFT JOIN mk USING (date) WHERE book IS NOT NULL AND bench IS NOT NULL)"""
SC = f"""{LEDGER}, sc AS (SELECT re.variant, re.as_of AS date, stocks, b.book, e.equal, mk.bench, b.book - mk.bench AS excess FROM re JOIN (SELECT variant, book.date, count(*) AS stocks, avg(r) AS book FROM book JOIN ahead a ON a.date = book.date AND a.code = book.code WHERE r IS NOT NULL GROUP BY 1, 2) b ON b.variant = re.variant AND b.date = re.as_of
 JOIN (SELECT date, avg(r) AS equal FROM ahead WHERE r IS NOT NULL GROUP BY 1) e ON e.date = re.as_of JOIN mk ON mk.date = re.as_of WHERE mk.bench IS NOT NULL)"""
TR = f"""{WEEKS}, pr AS (SELECT date, code, t, last_value(smooth IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM smooth),
lx AS (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1),
o1 AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS code, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, CAST(date_trunc('week', o_orderdate) AS DATE) AS opened, o_totalprice AS amount, o_orderkey % 2 = 0 AS in_book, CAST(o_orderkey % 30 AS INTEGER) AS plan_weeks FROM orders),
o2 AS (SELECT *, CASE WHEN status = 'closed' THEN CAST(opened + CAST(7 * (1 + id % 20) AS INTEGER) AS DATE) END AS closed FROM o1),
tr AS (SELECT o2.*, a.px AS entry_price, la.level AS entry_index, coalesce(closed, z.z) AS day, b.px AS price, lb.level AS idx FROM o2 JOIN pr a ON a.code = o2.code AND a.date = opened AND a.px IS NOT NULL JOIN lx la ON la.date = opened JOIN (SELECT code, max(date) AS z FROM pr WHERE px IS NOT NULL GROUP BY 1) z ON z.code = o2.code JOIN pr b ON b.code = o2.code AND b.date = coalesce(closed, z.z) JOIN lx lb ON lb.date = b.date),
ma AS (SELECT *, price / entry_price - 1 AS ret, CAST(date_diff('day', opened, day) AS INTEGER) AS days, price / entry_price - 1 - (idx / entry_index - 1) AS vs_index FROM tr)"""
AC = f"""{TR}, ac AS (SELECT g.date, 1000000000.0::DOUBLE + sum(CASE WHEN t.opened <= g.date AND (t.closed IS NULL OR g.date <= t.closed) THEN amount * (pr.px / entry_price - 1) WHEN t.closed < g.date THEN amount * (price / entry_price - 1) ELSE 0 END) AS value
 FROM (SELECT DISTINCT date FROM pr) g, tr t JOIN pr ON pr.code = t.code WHERE pr.date = g.date GROUP BY 1)"""
SQL = {
    "w60_chain_check": f"{LEDGER} SELECT * FROM ve",
    "x9_file_verify": f"{LEDGER} SELECT variant, count(*) AS files, count(CASE WHEN unchanged THEN 1 END) AS good, min(CASE WHEN NOT unchanged THEN file END) AS first_bad FROM ve GROUP BY 1",
    "x10_reveal": f"{LEDGER} SELECT variant, as_of, file FROM re WHERE seq % 3 != 0",
    "u4_completeness": f"{LEDGER} SELECT variant, count(*) AS files, count(CASE WHEN as_of + 31 > (SELECT max(date) FROM bars) THEN 1 END) AS missing, count(CASE WHEN as_of + 31 > (SELECT max(date) FROM bars) THEN 1 END) = 0 AS complete FROM com GROUP BY 1",
    "t6_ranked_list": f"{RB} SELECT date, code, CAST(position AS INTEGER) AS position, in_book, {r6('p')} AS p FROM rb",
    "t5_top_reasons": f"{WEEKS}, {CON} SELECT date, code, feature, contribution, CAST(row_number() OVER (PARTITION BY date, code ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS k FROM con QUALIFY k <= 5",
    "a46_attribution": f"""{RB}, {SECTOR}, x AS (SELECT date, code, coalesce(sector, 'Unknown') AS sector, in_book, r FROM rb LEFT JOIN sk USING (code) WHERE r IS NOT NULL),
 dy AS (SELECT date, count(*) AS n, count(CASE WHEN in_book THEN 1 END) AS nb, avg(r) AS r_all FROM x GROUP BY 1), ps AS (SELECT date, sector, count(*) AS ns, count(CASE WHEN in_book THEN 1 END) AS names, avg(r) AS sr, avg(CASE WHEN in_book THEN r END) AS rb FROM x GROUP BY 1, 2),
 w AS (SELECT date, sector, names, names / nb AS wb, ns / n AS wu, sr, (names / nb - ns / n) * (sr - r_all) AS al, names / nb * (coalesce(rb, sr) - sr) AS se FROM ps JOIN dy USING (date) WHERE nb > 0)
 SELECT date, sector, names, {r6('wb')} AS book_weight, {r6('wu')} AS universe_weight, {r6('sr')} AS sector_return, {r6('al')} AS allocation, {r6('se')} AS selection, {r6('al + se')} AS total FROM w""",
    "j15_sector_attach": f"{WEEKS}, {SECTOR} SELECT coalesce(sector, 'Unknown') AS sector, count(DISTINCT code) AS codes, count(*) AS weeks FROM bars LEFT JOIN sk USING (code) GROUP BY 1",
    "a47_postmortem": f"{PM} SELECT date, names, size, best, worst, reasons, book > bench AS beat_index, round(book - equal, 9) > 0 AS beat_equal, " + ", ".join(f"{r6(c)} AS {c}" for c in ("book", "equal", "bench", "rank_ic", "top_less_bottom", "favoured_return")) + " FROM pm",
    "x8_sentences": f"{PM} SELECT date, concat_ws('; ', CASE WHEN book > bench THEN 'The book beat the index' ELSE 'The book fell behind the index' END, CASE WHEN rank_ic > 0.02 THEN 'the ranking was right more often than not' WHEN rank_ic < -0.02 THEN 'the ranking was wrong more often than not' ELSE 'the ranking said little' END, CASE WHEN top_less_bottom > 0 THEN 'its top names did better than its last ones' END) AS sentence FROM pm",
    "f16_report_numbers": f"{PM} SELECT date, printf('%+.1f%%', round(round(book, 6) * 1000) / 10 + 0.0) AS book, printf('%d of %d', size, names) AS names, printf('%.3f', round(round(rank_ic, 6) * 1000) / 1000 + 0.0) AS rank_ic FROM pm",
    "a48_patterns": f"{PM}, {HEALTH}, pt AS (SELECT 'top' AS variant, CASE WHEN bench >= 0 THEN 'rising' ELSE 'falling' END AS mood, zone, book - bench AS excess, rank_ic FROM pm JOIN he USING (date)) SELECT variant, mood, zone, count(*) AS weeks, {r6('avg(excess)')} AS excess, {r6('avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END)')} AS hits, {r6('avg(rank_ic)')} AS rank_ic FROM pt GROUP BY GROUPING SETS ((variant, mood), (variant, zone)) HAVING count(*) >= 8",
    "a49_ledger_scores": f"{SC} SELECT variant, date, stocks, " + ", ".join(f"{r6(c)} AS {c}" for c in ("book", "equal", "bench", "excess")) + ", book > bench AS beat_index, round(book - equal, 9) > 0 AS beat_equal FROM sc",
    "a50_drift_watch": f"{SC}, l AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY variant ORDER BY date DESC) <= 13), g AS (SELECT variant, count(*) AS weeks, avg(CASE WHEN book > bench THEN 1.0 ELSE 0.0 END) AS hits, avg(excess) * 52 AS ex FROM l GROUP BY 1) SELECT variant, weeks, {r6('hits')} AS hits, {r6('ex')} AS excess_ann, CASE WHEN weeks >= 8 AND hits < 0.4 AND ex < 0 THEN 'warning' ELSE 'ok' END AS status FROM g",
    "a51_data_gate": f"""{WEEKS}, m AS (SELECT date, close, abs(close / last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) AS r FROM dense),
 g AS (SELECT date, count(close) AS names, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS missing, count(CASE WHEN r > 0.25 THEN 1 END) AS moves FROM m GROUP BY 1),
 h AS (SELECT *, CAST(sum(moves) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS big, date_diff('day', date, lead(date) OVER (ORDER BY date)) AS age FROM g)
 SELECT date, names, {r6('missing')} AS missing, big, CASE WHEN names < 5 OR missing > 0.5 OR age > 14 THEN 'stop' WHEN missing > 0.2 OR big > 0 OR age > 7 THEN 'warning' ELSE 'ok' END AS status FROM h""",
    "a52_risk_flags": f"""{WEEKS}, x AS (SELECT date, code, close, close / lag(close, 5) {LAGS} - 1 AS r5, coalesce(high = low AND abs(close / lag(close) {LAGS} - 1) >= 0.019::DOUBLE, false) AS locked, quantile_cont(value, 0.5) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS traded FROM dense),
 c AS (SELECT date, quantile_cont(traded, 0.1) AS cut FROM x WHERE close IS NOT NULL GROUP BY 1),
 y AS (SELECT x.date, x.code, concat_ws(',', CASE WHEN x.code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'surveillance' END, CASE WHEN locked THEN 'locked' END, CASE WHEN r5 <= -0.15 THEN 'fell' END, CASE WHEN traded < cut THEN 'thin' END) AS flags FROM x JOIN c USING (date) JOIN book b ON b.variant = 'top' AND b.date = x.date AND b.code = x.code)
 SELECT * FROM y WHERE flags != ''""",
    "a52_crowding": f"{WEEKS}, {SECTOR}, x AS (SELECT date, coalesce(sector, 'Unknown') AS sector FROM book LEFT JOIN sk USING (code) WHERE variant = 'top'), g AS (SELECT date, sector, count(*) / sum(count(*)) OVER (PARTITION BY date) AS share FROM x GROUP BY 1, 2) SELECT date, sector, {r6('share')} AS share FROM g WHERE sector != 'Unknown' AND share > 0.3",
    "a53_paper_marks": f"{TR} SELECT id, code, status, days, {r6('ret')} AS ret, {r6('vs_index')} AS vs_index, round(amount * ret, 2) AS pnl, concat_ws(',', CASE WHEN status = 'open' AND ret <= -0.1::DOUBLE THEN 'stop' END, CASE WHEN status = 'open' AND plan_weeks > 0 AND days >= 7 * plan_weeks THEN 'planned time' END) AS flags FROM ma",
    "a54_paper_digest": f"""{TR}, x AS (SELECT ret, vs_index, unnest(['all', CASE WHEN in_book THEN 'in the book' ELSE 'not in the book' END]) AS source FROM ma WHERE status = 'closed')
 SELECT source, count(*) AS closed, {r6('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r6('avg(ret)')} AS avg_return, {r6('avg(vs_index)')} AS avg_vs_index, {r6('avg(CASE WHEN vs_index > 0 THEN 1.0 ELSE 0.0 END)')} AS beat_index_rate, {r6('avg(CASE WHEN ret > 0 THEN ret END)')} AS avg_win, {r6('avg(CASE WHEN ret <= 0 THEN ret END)')} AS avg_loss, {r6('max(ret)')} AS best, {r6('min(ret)')} AS worst FROM x GROUP BY 1""",
    "w61_account_value": f"{AC} SELECT date, round(value, 0) AS value, {r6('value / max(value) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1')} AS drawdown FROM ac",
    "a55_position_gate": f"""{AC}, o AS (SELECT count(CASE WHEN status = 'open' THEN 1 END) AS "open" FROM tr), v AS (SELECT arg_max(value, date) / max(value) - 1 AS dd FROM ac), s AS (SELECT count(*) AS streak FROM (SELECT sum(CASE WHEN price < entry_price THEN 0 ELSE 1 END) OVER (ORDER BY closed DESC, id DESC) AS wins FROM tr WHERE status = 'closed') WHERE wins = 0)
 SELECT "open", {r6('dd')} AS drawdown, streak, concat_ws(',', CASE WHEN "open" >= 10 THEN 'too many open' END, CASE WHEN dd <= -0.1::DOUBLE THEN 'drawdown' END, CASE WHEN streak >= 3 THEN 'losing streak' END) AS reasons, NOT ("open" >= 10 OR dd <= -0.1::DOUBLE OR streak >= 3) AS may_open FROM o, v, s""",
    "t2_top_fifth": f"{WEEKS}, x AS (SELECT *, lead(volume) {LAGS} AS nx FROM dense), q AS (SELECT date, code, nx, (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS q FROM x WHERE close IS NOT NULL) SELECT date, code, {r6('q')} AS q FROM q WHERE q > 0.8 AND nx > 0",
    "t4_extremes": f"{WEEKS} SELECT code, date, {r6('r')} AS r, CAST(best AS INTEGER) AS best, CAST(worst AS INTEGER) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY r DESC, date) AS best, row_number() OVER (PARTITION BY code ORDER BY r, date) AS worst FROM ahead WHERE r IS NOT NULL) WHERE best <= 3 OR worst <= 3",
}
