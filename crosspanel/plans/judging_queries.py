"""Queries that judge factors further: flags, rounds, lessons, leakage, robustness, calibration and joins of their results, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.functions import features as ft
from crosspanel.operators import scoring as s
from crosspanel.operators import blocks, wide
from crosspanel.plans import book_queries as bk
from crosspanel.plans import research_queries as rq
from crosspanel.plans.book_queries import AHEAD, R6, r6
from crosspanel.plans.factor_queries import LAGS, WITH
from crosspanel.plans.panel_queries import CANDLES
from crosspanel.plans.research_queries import CLOSEST, RANKED, corr_sql, rank_sql
from crosspanel.plans.table_queries import RANKS, SCORED, scored
from crosspanel.sources import panel as p

#: Thresholds of the shortlist, who made which factor, and from when on each maker may have known the answers.
STRONG_T, STRONG_IC, SAME_YEARS, NEW, SLOW = 3.0, 0.015, 0.7, 0.7, 0.8
OWNERS = {"level": "alpha", "size": "alpha", "move": "beta", "range": "beta"}
CUTOFFS = {"alpha": "1999-06-30", "beta": "1998-12-31", "gamma": "2010-01-01"}
DISCOVERY, LEAST_WEEKS = "1997-12-31", 26
USEFUL = ("keep", "star")
VERDICTS = ("star", "keep", "backwards", "copy", "costly", "weak", "unstable", "broken", "duplicate")
REASONS = {
    "broken": "no coefficient could be computed", "copy": "too close to a stronger factor", "backwards": "works in reverse", "weak": "no reliable signal", "unstable": "direction changes from year to year",
    "costly": "does not pay for its turnover", "star": "strong after costs", "keep": "works after costs",
}


def weekly_ic(x: DataFrame) -> DataFrame:
    return x.groupBy("factor", "date").agg(rq.corr("rx", "rw").alias("ic")).where("ic is not null")


def a14_signed_spread(spark, d):
    """With the factor turned to the sign of its mean coefficient: yearly mean of top less bottom and of top less all."""
    x = scored(spark, d)
    sign = s.spearman_ic(x).agg(F.when(F.avg("ic") < 0, -1).otherwise(1).alias("sign"))
    q = x.where("f is not null").select("date", "fwd", (f.avg_rank(F.col("f")) / F.count("f").over(f.by_date())).alias("q")).join(F.broadcast(sign), how="cross")  # one row
    q = q.withColumn("q", F.when(F.col("sign") < 0, 1 - F.col("q")).otherwise(F.col("q")))
    mean = lambda e: F.avg(F.when(e, F.col("fwd")))
    day = q.groupBy("date", "sign").agg((mean(F.col("q") > 0.8) - mean(F.col("q") <= 0.2)).alias("spread"), (mean(F.col("q") > 0.8) - F.avg("fwd")).alias("top"))
    return day.groupBy("sign").agg(F.count("spread").alias("weeks"), R6(F.avg("spread") * 52).alias("spread_ann"), R6(F.avg("top") * 52).alias("top_ann"))


def autocorrelation(x: DataFrame) -> DataFrame:
    """By factor the mean correlation of the ranks of a week and the one before."""
    before = x.select("factor", "code", F.date_add("date", 7).alias("date"), F.col("rx").alias("ry"))
    day = x.join(before, ["factor", "code", "date"]).groupBy("factor", "date").agg(F.count("*").alias("k"), rq.corr("rx", "ry").alias("c")).where(F.col("k") >= rq.LEAST_NAMES)
    return day.groupBy("factor").agg(F.avg("c").alias("autocorr"))


def flagged(spark, d) -> DataFrame:
    x = rq.ranked(spark, d)
    judge = rq.judged(x)
    y = judge.join(rq.closest(x, judge), "factor", "left").join(autocorrelation(x), "factor", "left")
    strong = (F.abs("t") >= STRONG_T) & (F.abs("ic") >= STRONG_IC) & (F.col("stable") >= SAME_YEARS)
    novel = F.coalesce(F.col("max_corr") < NEW, F.lit(True))
    slow = F.coalesce(F.col("autocorr") >= SLOW, F.lit(False))
    return y.withColumns({"strong": F.coalesce(strong, F.lit(False)), "novel": novel, "slow": slow})


def a17_shortlist(spark, d):
    """Flags of each factor, and whether all hold."""
    return flagged(spark, d).select("factor", "strong", "novel", "slow", (F.col("strong") & F.col("novel")).alias("shortlist"), R6(F.col("autocorr")).alias("autocorr"))


def owner(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(e) for kv in OWNERS.items() for e in kv)), c)


def a18_producers(spark, d):
    """Each maker's factors: how many, median strength, how many strong and novel, the share of the wrong sign, and the best."""
    x = flagged(spark, d).withColumn("maker", owner(F.col("factor")))
    share = lambda e: R6(100 * F.avg(e.cast("double")))
    return x.groupBy("maker").agg(
        F.count("*").alias("factors"), R6(F.percentile(F.abs("ic"), 0.5)).alias("median_ic"), F.count_if("strong").alias("strong"), F.count_if("novel").alias("novel"), F.count_if(F.col("strong") & F.col("novel")).alias("shortlist"), share(F.col("ic") < 0).alias("wrong_sign_pct"), F.max_by("factor", F.abs("t")).alias("best")
    )


KNOWN = [*ft.SHAPES, *(f"{k}5" for k in ft.FAMILY)]


def known_bars(x: DataFrame) -> DataFrame:
    return x.select("date", "code", "t", "high", "low", "close", "volume", *(e.alias(k) for k, e in ft.candles().items()))


def known_matrix(spark, d) -> DataFrame:
    """date, code, the same-day shapes and the five-week family of the bars, as the blueprint's library makes them: a window is of a code's last five bars."""
    x = known_bars(p.bars(spark, d).where("date is not null and code is not null").withColumn("t", F.datediff("date", F.lit("1970-01-05").cast("date")) / 7))
    return wide.rolling_rows(x, (5,), ft.FAMILY, f.TINY, ("date", "code", "close"), ft.SHAPES, 9).where("close is not null").select("date", "code", *KNOWN)


def known_features(spark, d) -> DataFrame:
    """date, code, feature and x: the known matrix by feature."""
    return known_matrix(spark, d).unpivot(["date", "code"], KNOWN, "feature", "x").where("x is not null")


def ranked_features(x: DataFrame, y: DataFrame) -> DataFrame:
    """Ranks of features and of `y`'s r among the names of a date that have both."""
    both = x.join(y.where("r is not null"), ["date", "code"])
    day = ("date", "feature")
    rank = lambda c: F.rank().over(Window.partitionBy(*day).orderBy(c)) + (F.count("*").over(Window.partitionBy(*day, c)) - 1) / 2
    return both.select(*day, "code", rank("x").alias("rx"), rank("r").alias("rw"), F.count("*").over(Window.partitionBy(*day)).alias("n")).where(F.col("n") >= rq.LEAST_NAMES)


def a19_feature_strength(spark, d):
    """Over the candle shapes: the best by its mean coefficient, the median strength, and the mean of the ten strongest."""
    x = ft.candles()
    wide = p.bars(spark, d).select("date", "code", *(F.round(e, 9).alias(k) for k, e in x.items())).unpivot(["date", "code"], list(x), "feature", "x").where("x is not null")
    ic = ranked_features(wide, bk.ahead(spark, d)).groupBy("date", "feature").agg(rq.corr("rx", "rw").alias("ic")).groupBy("feature").agg(F.round(F.abs(F.avg("ic")), 9).alias("ic"))
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ic"), "feature"))  # one row for each feature
    return ic.withColumn("k", k).agg(F.count("*").alias("features"), F.min_by("feature", "k").alias("best"), R6(F.max("ic")).alias("best_ic"), R6(F.percentile("ic", 0.5)).alias("median_ic"), R6(F.avg(F.when(F.col("k") <= 10, F.col("ic")))).alias("top_ten"))


def a20_against_benchmark(spark, d):
    """The weekly judge where only names that trade in the next week can be bought, against the universe and the benchmark."""
    x = rq.ranked(spark, d)
    volume = p.dense_bars(spark, d).select("date", "code", (F.lead("volume").over(f.by_code()) > 0).alias("can_buy"))
    top = x.join(volume, ["date", "code"]).where((F.col("rx") / F.col("n") > rq.TOP) & F.coalesce("can_buy", F.lit(False)))
    day = top.groupBy("factor", "date").agg(F.count("*").alias("bought"), F.avg("fwd").alias("top"))
    all_ = x.groupBy("factor", "date").agg(F.avg("fwd").alias("universe"))
    y = day.join(all_, ["factor", "date"]).join(bk.market(spark, d), "date")
    return y.groupBy("factor").agg(F.count("*").alias("weeks"), F.sum("bought").alias("bought"), R6(F.avg(F.col("top") - F.col("universe")) * 52).alias("over_universe"), R6(F.avg(F.col("top") - F.col("bench")) * 52).alias("over_bench"))


def a21_verdict_reason(spark, d):
    """The verdict of each factor in words; a factor of the same ranks as one before it in the alphabet is a duplicate."""
    reason = F.element_at(F.create_map(*(F.lit(e) for kv in REASONS.items() for e in kv)), F.col("verdict"))
    x = rq.ranked(spark, d)
    prints = x.groupBy("factor").agg(F.sum(F.xxhash64("date", "code", "rx").cast("decimal(38,0)")).alias("print"), F.count("*").alias("k"))
    first = prints.groupBy("print", "k").agg(F.min("factor").alias("first"))
    same = prints.join(first, ["print", "k"]).where("factor != first").select("factor", "first")
    y = rq.a21_verdict(spark, d).join(same, "factor", "left")
    said = F.when(F.col("first").isNotNull(), F.concat(F.lit("same as "), "first")).otherwise(F.concat(reason, F.when((F.col("verdict") == "copy"), F.concat(F.lit(": "), "closest")).otherwise(F.lit(""))))
    return y.select("factor", F.when(F.col("first").isNotNull(), "duplicate").otherwise(F.col("verdict")).alias("verdict"), said.alias("reason"))


def reviewed(spark, d) -> DataFrame:
    """Reviewed proposals made from the orders: researcher, arm, round, category, verdict, status, ic, t, net and turnover."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), (k % 9 + 1).cast("int"))
    x = p.read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("researcher"), F.when(F.col("o_orderstatus") == "F", "feedback").otherwise("control").alias("arm"), (F.year("o_orderdate") - 1995).alias("round"), k.alias("id"), F.element_at(F.array(*map(F.lit, ("momentum", "volume", "other"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("category"),
        verdict.alias("verdict"), ((price % 997) / 9970 - 0.05).alias("ic"), ((price % 89) / 10 - 4).alias("t"), ((price % 499) / 4990 - 0.03).alias("net"), (price % 101 / 100).alias("turnover"),
    )
    return x.withColumns({"valid": ~F.col("verdict").isin("broken", "duplicate"), "scored": ~F.col("verdict").isin("broken", "duplicate")})


def a22_round_statistics(spark, d):
    """By researcher, arm and round: proposals by verdict, shares, the upper median strength and the best useful net."""
    pct = lambda v: R6(100 * F.avg((F.col("verdict") == v).cast("double")))
    useful = F.col("verdict").isin(*USEFUL)
    x = reviewed(spark, d)
    # the upper of the middle two, by rank within the group
    by = ("researcher", "arm", "round")
    y = x.where("scored").withColumns({"m": F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("ic"), "id")), "k": F.count("*").over(Window.partitionBy(*by))})
    median = y.where(F.col("m") == F.floor(F.col("k") / 2) + 1).select(*by, R6(F.abs("ic")).alias("median_ic"))
    made = x.groupBy(*by).agg(
        F.count("*").alias("proposed"), R6(100 * F.avg(F.col("valid").cast("double"))).alias("valid_pct"), F.count_if("scored").alias("scored"), F.count_if(useful).alias("useful"), R6(100 * F.avg(useful.cast("double"))).alias("useful_pct"), F.count_if(F.col("verdict") == "star").alias("stars"),
        *(pct(v).alias(f"{v}_pct") for v in ("backwards", "copy", "costly", "broken")), R6(F.max(F.when(useful, F.col("net")))).alias("best_net"),
    )
    return made.join(median, list(by), "left")


def a23_lessons(spark, d):
    """What a researcher's proposals teach: rules by category and over all."""
    x = reviewed(spark, d)
    some = x.where("scored")
    cat = some.groupBy("researcher", "category").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "backwards").alias("back"), F.count_if(F.col("verdict").isin(*USEFUL)).alias("good"))
    rule = F.when((F.col("n") >= 2) & (F.col("back") / F.col("n") >= 0.5), "mostly in reverse").when(F.col("good") >= 2, "works best")
    first = cat.select("researcher", F.concat_ws(": ", "category", rule).alias("lesson"), rule.alias("rule")).where("rule is not null").drop("rule")
    signal = some.where(F.abs("t") >= rq.T_SIGNAL)
    by = Window.partitionBy("researcher")
    fast = signal.withColumns({"m": F.row_number().over(by.orderBy("turnover", "id")), "k": F.count("*").over(by)}).where((F.col("m") == F.floor(F.col("k") / 2) + 1) & (F.col("turnover") > 0.5)).select("researcher", F.lit("signals change too fast").alias("lesson"))
    total = x.groupBy("researcher").agg(F.avg((F.col("verdict") == "broken").cast("double")).alias("broken"), F.count_if(F.col("verdict") == "copy").alias("copies"))
    broken = total.where("broken > 0.2").select("researcher", F.lit("many break the rules").alias("lesson"))
    copies = total.where("copies >= 3").select("researcher", F.lit("several restate known factors").alias("lesson"))
    return first.union(fast).union(broken).union(copies)


def a24_feedback_against_control(spark, d):
    """By researcher the useful share of both arms in round 0, in the first and last later round, and on average of the later rounds."""
    x = reviewed(spark, d).groupBy("researcher", "arm", "round").agg((100 * F.avg(F.col("verdict").isin(*USEFUL).cast("double"))).alias("u"))
    later = F.when(F.col("round") > 0, F.col("u"))
    y = x.groupBy("researcher", "arm").agg(F.max(F.when(F.col("round") == 0, F.col("u"))).alias("zero"), F.min_by("u", F.when(F.col("round") > 0, F.col("round"))).alias("first"), F.max_by("u", F.when(F.col("round") > 0, F.col("round"))).alias("last"), F.avg(later).alias("mean"))
    wide = y.groupBy("researcher").pivot("arm", ["feedback", "control"]).agg(*(F.first(c).alias(c) for c in ("zero", "first", "last", "mean")))
    return wide.select("researcher", *(R6(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a in ("feedback", "control") for c in ("zero", "first", "last", "mean")))


def markets(spark, d) -> DataFrame:
    """By factor and market (odd and even codes, each ranked on its own) the mean coefficient and its t."""
    x = rq.ranked(spark, d).withColumn("market", F.col("code") % 2)
    day = ("market", "date", "factor")
    ic = wide.ranks_within(x.select(*day, "rx", "rw"), day, ("rx", "rw")).groupBy(*day).agg(F.count("*").alias("k"), rq.corr("rx", "rw").alias("ic")).where(F.col("k") >= rq.LEAST_NAMES)
    m, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.groupBy("factor", "market").agg(m.alias("ic"), (m / sd * F.sqrt(n)).alias("t"))


def j6_two_markets(spark, d):
    """The results of both markets side by side, with suffixes, and the weaker of both t."""
    x = markets(spark, d)
    a = x.where("market = 0").select("factor", F.col("ic").alias("ic_even"), F.col("t").alias("t_even"))
    b = x.where("market = 1").select("factor", F.col("ic").alias("ic_odd"), F.col("t").alias("t_odd"))
    weaker = F.least(F.abs("t_even"), F.abs("t_odd"))
    return a.join(b, "factor").select("factor", *(R6(F.col(c)).alias(c) for c in ("ic_even", "t_even", "ic_odd", "t_odd")), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(weaker, 9)), "factor")).alias("place"))  # a row for each factor


def a25_transfer_ranks(spark, d):
    """Spearman correlation of the coefficients of both markets."""
    x = markets(spark, d).groupBy("factor").agg(*(F.max(F.when(F.col("market") == k, F.col("ic"))).alias(f"ic{k}") for k in (0, 1)))
    place = lambda c: F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.round(c, 9)))
    return x.select(place("ic0").alias("a"), place("ic1").alias("b")).agg(F.count("*").alias("factors"), R6(F.corr("a", "b")).alias("rank_corr"))


def calibrated(spark, d) -> DataFrame:
    """p, a score of documents from their length, and y, their label."""
    score = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    return p.read(spark, d, "documents").join(p.read(spark, d, "labels"), "doc_id").where("n_chars is not null").select(F.round(score, 6).alias("p"), F.col("quality").cast("double").alias("y"))


def a27_calibration_summary(spark, d):
    """Brier score, that without skill, skill, calibration error over bins (a, b], and the sure ones: share and hits."""
    x = calibrated(spark, d)
    bin_ = F.greatest(F.lit(1), F.ceil(F.col("p") * 10)).cast("int")
    bins = x.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    ece = bins.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))
    sure = F.col("p") >= 0.6
    one = x.agg(F.count("*").alias("n"), F.avg("y").alias("base"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(F.when(sure, F.col("y"))).alias("sure_hits"), F.avg(sure.cast("double")).alias("sure_share"))
    none = F.col("base") * (1 - F.col("base"))
    return one.join(ece, how="cross").select("n", *(R6(e).alias(k) for k, e in {"base": F.col("base"), "brier": F.col("brier"), "no_skill": none, "skill": 1 - F.col("brier") / none, "ece": F.col("ece"), "sure_hits": F.col("sure_hits"), "sure_share": F.col("sure_share")}.items()))  # one row each


def a28_prediction_ic(spark, d):
    """Weekly rank correlation of predictions and excess, both ranked anew among the names that have both; mean and t."""
    x = p.bars(spark, d).select("date", "code", F.col("volume").alias("x")).join(bk.ahead(spark, d).where("r is not null"), ["date", "code"]).withColumn("feature", F.lit("volume"))
    day = ("date",)
    rank = lambda c: F.rank().over(Window.partitionBy(*day).orderBy(c)) + (F.count("*").over(Window.partitionBy(*day, c)) - 1) / 2
    ic = x.select("date", rank("x").alias("a"), rank("r").alias("b")).groupBy("date").agg(rq.corr("a", "b").alias("ic")).where("ic is not null")
    return ic.agg(F.count("*").alias("weeks"), R6(F.avg("ic")).alias("ic"), R6(F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*"))).alias("t"))


def a30_importance(spark, d):
    """Each factor's share of all strength, and that of its maker's factors."""
    x = weekly_ic(rq.ranked(spark, d)).groupBy("factor").agg(F.sum(F.abs("ic")).alias("gain")).withColumn("maker", owner(F.col("factor")))
    total = F.sum("gain").over(Window.partitionBy(F.lit(1)))  # a row for each factor
    return x.select("factor", "maker", R6(F.col("gain") / total).alias("share"), R6(F.sum("gain").over(Window.partitionBy("maker")) / total).alias("maker_share"))


def before_and_after(spark, d) -> DataFrame:
    """label, factor, mine, and the mean coefficient before and after the label's cutoff, each in the direction of its discovery years."""
    ic = weekly_ic(rq.ranked(spark, d))
    sign = ic.where(F.col("date") <= DISCOVERY).groupBy("factor").agg(F.when(F.avg("ic") < 0, -1.0).otherwise(1.0).alias("sign"))
    ic = ic.join(sign, "factor").withColumn("ic", F.col("ic") * F.col("sign"))
    labels = spark.createDataFrame(list(CUTOFFS.items()), "label string, cutoff string").select("label", F.to_date("cutoff").alias("cutoff"))
    x = ic.where(F.col("date") > DISCOVERY).join(F.broadcast(labels), how="cross")  # a few labels
    early = F.col("date") <= F.col("cutoff")
    return x.groupBy("label", "cutoff", "factor").agg(F.avg(F.when(early, F.col("ic"))).alias("before"), F.avg(F.when(~early, F.col("ic"))).alias("after"), F.count_if(early).alias("weeks_before"), F.count_if(~early).alias("weeks_after")).withColumn("mine", owner(F.col("factor")) == F.col("label"))


def j18_owner_split(spark, d):
    return before_and_after(spark, d).select("label", "factor", "mine", "weeks_before", "weeks_after", R6(F.col("before")).alias("before"), R6(F.col("after")).alias("after"))


def a35_leakage(spark, d):
    """By label: whether its own factors lost more after its cutoff than those of others did, in units of the pooled error."""
    x = before_and_after(spark, d).withColumn("drop", F.col("before") - F.col("after"))
    side = lambda e, fn: fn(F.when(e, F.col("drop")))
    mine, other = F.col("mine"), ~F.col("mine")
    y = x.groupBy("label").agg(F.count_if(mine).alias("factors"), F.max("weeks_before").alias("weeks_before"), F.max("weeks_after").alias("weeks_after"), side(mine, F.avg).alias("own"), side(other, F.avg).alias("placebo"), (side(mine, F.var_samp) / side(mine, F.count) + side(other, F.var_samp) / side(other, F.count)).alias("v"))
    z = (F.col("own") - F.col("placebo")) / F.sqrt("v")
    status = F.when((F.col("factors") == 0) | (F.col("weeks_after") == 0), "cutoff outside the held-out years").when((F.col("weeks_before") < LEAST_WEEKS) | (F.col("weeks_after") < LEAST_WEEKS), "too few weeks").when(z > 2, "MEMORY SIGNAL").otherwise("no memory signal")
    tested = ~status.isin("cutoff outside the held-out years", "too few weeks")
    return y.select("label", "factors", "weeks_before", "weeks_after", status.alias("status"), R6(F.when(tested, F.col("own") - F.col("placebo"))).alias("extra_drop"), R6(F.when(tested, z)).alias("z"))


def a57_robustness(spark, d):
    """A move over three weeks beside the same with other windows: a variant holds with the same sign and half the strength; robust if two thirds hold."""
    c, ahead = F.col("close"), lambda k: F.lead("open", k).over(f.by_code())
    x = p.dense_bars(spark, d).select("date", "code", *((c / f.ref(c, k)).alias(f"move{k}") for k in (3, 2, 4, 6)), (ahead(6) / ahead(1) - 1).alias("r"))
    long = x.unpivot(["date", "code", "r"], [f"move{k}" for k in (3, 2, 4, 6)], "feature", "x").where("x is not null and r is not null")
    ic = ranked_features(long.drop("r"), x.select("date", "code", "r")).groupBy("date", "feature").agg(rq.corr("rx", "rw").alias("ic"))
    t = ic.groupBy("feature").agg((F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("ic"))).alias("t"))
    base = t.where("feature = 'move3'").select(F.col("t").alias("t0"))
    held = F.count_if((F.signum("t") == F.signum("t0")) & (F.abs("t") >= 0.5 * F.abs("t0")))
    y = t.where("feature != 'move3'").join(base, how="cross").agg(held.alias("held"), F.count("*").alias("tried"), R6(F.max("t0")).alias("t0"))  # one row
    return y.select("held", "tried", "t0", F.when(F.col("held") * 3 >= 2 * F.col("tried"), "robust").otherwise("fragile").alias("status"))


def a59_distinct_counts(spark, d):
    return p.read(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("codes"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.date_trunc("week", "l_shipdate")).alias("weeks"))


def j3_market_on_rows(spark, d):
    """The market's trailing return of four weeks on every row of its date: one row a date, so its size is that of the calendar."""
    x = p.benchmark(p.bars(spark, d)).withColumn("series", F.lit("all"))
    market = x.select("date", (F.col("level") / F.lag("level", 4).over(Window.partitionBy("series").orderBy("date")) - 1).alias("mkt_ret4"))
    return p.bars(spark, d).select("date", "code").join(F.broadcast(market), "date", "left").select("date", "code", R6(F.col("mkt_ret4")).alias("mkt_ret4"))


def j4_label_alignment(spark, d):
    """Each row of features with its label; rows past the last known one keep a null."""
    label = bk.ahead(spark, d).select("date", "code", (F.col("r") > 0).alias("y"))
    return p.bars(spark, d).select("date", "code", R6(F.col("close") / F.col("open")).alias("feature")).join(label, ["date", "code"], "left")


def j5_predictions_with_outcomes(spark, d):
    """Pairs of score and outcome where both are known, by date."""
    x = p.bars(spark, d).select("date", "code", F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).alias("p")).join(bk.ahead(spark, d), ["date", "code"]).dropna()
    return x.groupBy("date").agg(F.count("*").alias("pairs"), R6(F.avg("p")).alias("p"), R6(F.avg("r")).alias("r"))


def j13_closest_feature(spark, d):
    """For each factor the candle shape whose ranks are most like its own, by the mean correlation over dates."""
    x = rq.ranked(spark, d)
    shapes = ft.candles()
    wide = p.bars(spark, d).select("date", "code", *(F.round(e, 9).alias(k) for k, e in shapes.items())).unpivot(["date", "code"], list(shapes), "feature", "x").where("x is not null")
    rank = F.rank().over(Window.partitionBy("date", "feature").orderBy("x")) + (F.count("*").over(Window.partitionBy("date", "feature", "x")) - 1) / 2
    known = wide.select("date", "code", "feature", rank.alias("ry"))
    day = x.select("date", "code", "factor", "rx").join(known, ["date", "code"]).groupBy("factor", "feature", "date").agg(rq.corr("rx", "ry").alias("c"))
    each = day.groupBy("factor", "feature").agg(F.round(F.abs(F.avg("c")), 6).alias("c"))
    return each.groupBy("factor").agg(F.max("c").alias("max_corr"), F.max_by("feature", F.struct("c", "feature")).alias("closest"))


def j14_priority(spark, d):
    """A part's price from the first source that has one: returned items, then open ones, then the list; and which it was."""
    price = lambda flag, name: p.read(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias(name))
    x = p.read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast("double").alias("list"))
    x = x.join(price("R", "returned"), "l_partkey", "left").join(price("N", "open"), "l_partkey", "left")
    return x.select("l_partkey", R6(F.coalesce("returned", "open", "list")).alias("price"), F.when(F.col("returned").isNotNull(), "returned").when(F.col("open").isNotNull(), "open").otherwise("list").alias("source"))


def j16_two_sources(spark, d):
    """Codes from a shortlist and from a list of useful ones; where a name is on both the shortlist's entry stays."""
    n = p.read(spark, d, "customer").select("c_name", "c_mktsegment", "c_acctbal")
    rich = n.where("c_acctbal > 6000").select("c_name", F.lit("shortlist").alias("source"), F.lit(1).alias("priority"))
    useful = n.where("c_mktsegment = 'BUILDING'").select("c_name", F.lit("useful"), F.lit(2))
    k = F.row_number().over(Window.partitionBy("c_name").orderBy("priority"))
    return rich.union(useful).withColumn("k", k).where("k = 1").select("c_name", "source")


def t1_monthly_universe(spark, d):
    """Members of each month: the 20 codes of the most value in the month before, on all its weeks; months after one of less than ten candidates have none."""
    x = p.bars(spark, d)
    month = x.groupBy(F.trunc("date", "MM").alias("month"), "code").agg(F.round(F.sum("value"), 2).alias("value"))
    w = Window.partitionBy("month")
    top = month.withColumns({"k": F.row_number().over(w.orderBy(F.desc("value"), "code")), "n": F.count("*").over(w)}).where("k <= 20 and n >= 10")
    members = top.select(F.add_months("month", 1).alias("month"), "code", "k")
    return x.select("date").distinct().withColumn("month", F.trunc("date", "MM")).join(members, "month").select("date", "code", "k")


def w38_feature_matrix(spark, d):
    """The shapes and the five-week family of members as 32-bit numbers, none infinite; shown by feature."""
    return wide.totals(known_matrix(spark, d), KNOWN).select("feature", "n", F.round("mean", 3).alias("mean"), F.round("most", 1).alias("most"))


def w39_all_ranks(spark, d):
    """Centred ranks of every shape and five-week feature by date, a day in one go; shown by feature."""
    x = known_bars(p.code_bars(spark, d, p.calendar(spark, d)[0]))
    days = blocks.of_days(x, wide.last_rows((5,), ft.FAMILY, f.TINY, ft.SHAPES, 9), KNOWN, kind=np.float64)
    y = blocks.rank_totals(days, KNOWN, lambda codes: np.fmod(codes, 7), np.float64)
    return y.groupBy("feature").agg(F.sum("n").alias("n"), R6(F.sum("total") / F.sum("n")).alias("check"), R6(F.max("most")).alias("most"))


def w45_dispersion(spark, d):
    """The spread of the names' returns of four weeks, by date."""
    x = p.dense_bars(spark, d).select("date", (F.col("close") / F.lag("close", 4).over(f.by_code()) - 1).alias("r")).where("r is not null")
    return x.groupBy("date").agg(F.count("*").alias("names"), R6(F.stddev_samp("r")).alias("dispersion"))


def w49_book_alpha(spark, d):
    """Each variant's alpha on the universe over 52 weeks, in a year."""
    w52 = Window.partitionBy("variant").orderBy("date").rowsBetween(-51, 0)
    x = bk.known_weeks(spark, d)
    return x.select("variant", "date", R6(F.when(F.count("*").over(w52) == 52, F.regr_intercept("net", "universe").over(w52) * 52)).alias("alpha"))


CALLS = (
    a14_signed_spread, a17_shortlist, a18_producers, a19_feature_strength, a20_against_benchmark, a21_verdict_reason, a22_round_statistics, a23_lessons, a24_feedback_against_control, j6_two_markets, a25_transfer_ranks, a27_calibration_summary,
    a28_prediction_ic, a30_importance, j18_owner_split, a35_leakage, a57_robustness, a59_distinct_counts, j3_market_on_rows, j4_label_alignment, j5_predictions_with_outcomes, j13_closest_feature, j14_priority, j16_two_sources,
    t1_monthly_universe, w38_feature_matrix, w39_all_ranks, w45_dispersion, w49_book_alpha,
)
QUERIES = {c.__name__: c for c in CALLS}

WIC = f"{RANKED}, wic AS (SELECT * FROM (SELECT factor, date, {corr_sql('rx', 'rw')} AS ic FROM ranked GROUP BY 1, 2) WHERE ic IS NOT NULL)"
OWN = "CASE WHEN factor IN ('level', 'size') THEN 'alpha' ELSE 'beta' END"
FLAGS = f"""{CLOSEST}, au AS (SELECT factor, avg(c) AS autocorr FROM (SELECT a.factor, a.date, {corr_sql('a.rx', 'b.rx')} AS c FROM ranked a JOIN ranked b ON b.factor = a.factor AND b.code = a.code AND b.date + 7 = a.date GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1),
fl AS (SELECT judged.*, autocorr, coalesce(abs(t) >= 3 AND abs(ic) >= 0.015 AND stable >= 0.7, false) AS strong, coalesce(max_corr < 0.7, true) AS novel, coalesce(autocorr >= 0.8, false) AS slow FROM judged LEFT JOIN closest USING (factor) LEFT JOIN au USING (factor))"""
SHAPES = f"sh AS (SELECT date, code, unnest([{', '.join(repr(k) for k in CANDLES)}]) AS feature, round(unnest([{', '.join(CANDLES.values())}]), 9) AS x FROM (SELECT *, value / volume AS vwap, high - low + 1e-12 AS span FROM bars))"
REV = """WITH rv AS (SELECT o_orderpriority AS researcher, CASE WHEN o_orderstatus = 'F' THEN 'feedback' ELSE 'control' END AS arm, CAST(year(o_orderdate) - 1995 AS INTEGER) AS round, o_orderkey AS id, ['momentum', 'volume', 'other'][o_custkey % 3 + 1] AS category,
 ['star', 'keep', 'backwards', 'copy', 'costly', 'weak', 'unstable', 'broken', 'duplicate'][o_orderkey % 9 + 1] AS verdict, (o_totalprice % 997) / 9970 - 0.05::DOUBLE AS ic, (o_totalprice % 89) / 10 - 4 AS t, (o_totalprice % 499) / 4990 - 0.03::DOUBLE AS net, o_totalprice % 101 / 100 AS turnover FROM orders),
rs AS (SELECT *, verdict NOT IN ('broken', 'duplicate') AS scored, verdict IN ('keep', 'star') AS useful FROM rv)"""


def _pct(v: str) -> str:
    return r6(f"100 * avg(CASE WHEN {v} THEN 1.0 ELSE 0.0 END)")


MK = f"""{RANKED}, mk2 AS (SELECT code % 2 AS market, date, factor, {rank_sql('rx', 'code % 2, date, factor')} AS rx, {rank_sql('rw', 'code % 2, date, factor')} AS rw FROM ranked),
mi AS (SELECT market, date, factor, {corr_sql('rx', 'rw')} AS ic FROM mk2 GROUP BY 1, 2, 3 HAVING count(*) >= 5), me AS (SELECT factor, market, avg(ic) AS ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t FROM mi GROUP BY 1, 2),
tw AS (SELECT factor, max(CASE WHEN market = 0 THEN ic END) AS ic_even, max(CASE WHEN market = 0 THEN t END) AS t_even, max(CASE WHEN market = 1 THEN ic END) AS ic_odd, max(CASE WHEN market = 1 THEN t END) AS t_odd FROM me GROUP BY 1)"""
BA = f"""{WIC}, sg AS (SELECT factor, CASE WHEN avg(ic) < 0 THEN -1.0 ELSE 1.0 END AS sign FROM wic WHERE date <= DATE '{DISCOVERY}' GROUP BY 1),
ba AS (SELECT label, factor, {OWN} = label AS mine, avg(CASE WHEN date <= cutoff THEN ic * sign END) AS before, avg(CASE WHEN date > cutoff THEN ic * sign END) AS after, count(CASE WHEN date <= cutoff THEN 1 END) AS weeks_before, count(CASE WHEN date > cutoff THEN 1 END) AS weeks_after
 FROM wic JOIN sg USING (factor), (VALUES {', '.join(f"('{k}', DATE '{v}')" for k, v in CUTOFFS.items())}) l(label, cutoff) WHERE date > DATE '{DISCOVERY}' GROUP BY 1, 2, 3)"""
LK = f"""{BA}, lk AS (SELECT label, count(CASE WHEN mine THEN 1 END) AS factors, max(weeks_before) AS weeks_before, max(weeks_after) AS weeks_after, avg(CASE WHEN mine THEN before - after END) AS own, avg(CASE WHEN NOT mine THEN before - after END) AS placebo,
 var_samp(CASE WHEN mine THEN before - after END) / count(CASE WHEN mine THEN before - after END) + var_samp(CASE WHEN NOT mine THEN before - after END) / count(CASE WHEN NOT mine THEN before - after END) AS v FROM ba GROUP BY 1),
ls AS (SELECT *, CASE WHEN factors = 0 OR weeks_after = 0 THEN 'cutoff outside the held-out years' WHEN weeks_before < 26 OR weeks_after < 26 THEN 'too few weeks' WHEN (own - placebo) / sqrt(v) > 2 THEN 'MEMORY SIGNAL' ELSE 'no memory signal' END AS status FROM lk)"""
SQL = {
    "a14_signed_spread": f"""{SCORED}, {RANKS}, ic AS (SELECT date, corr(f, fwd) AS ic FROM ranks WHERE f IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 30), sg AS (SELECT CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END AS sign FROM ic),
 q AS (SELECT date, r, sign, CASE WHEN sign < 0 THEN 1 - f / nf ELSE f / nf END AS q FROM ranks, sg WHERE f IS NOT NULL), dy AS (SELECT date, sign, avg(r) FILTER (q > 0.8) - avg(r) FILTER (q <= 0.2) AS spread, avg(r) FILTER (q > 0.8) - avg(r) AS top FROM q GROUP BY 1, 2)
 SELECT sign, count(spread) AS weeks, {r6('avg(spread) * 52')} AS spread_ann, {r6('avg(top) * 52')} AS top_ann FROM dy GROUP BY 1""",
    "a17_shortlist": f"{FLAGS} SELECT factor, strong, novel, slow, strong AND novel AS shortlist, {r6('autocorr')} AS autocorr FROM fl",
    "a18_producers": f"{FLAGS} SELECT {OWN} AS maker, count(*) AS factors, {r6('quantile_cont(abs(ic), 0.5)')} AS median_ic, count(CASE WHEN strong THEN 1 END) AS strong, count(CASE WHEN novel THEN 1 END) AS novel, count(CASE WHEN strong AND novel THEN 1 END) AS shortlist, {_pct('ic < 0')} AS wrong_sign_pct, arg_max(factor, abs(t)) AS best FROM fl GROUP BY 1",
    "a19_feature_strength": f"""{WITH}, {AHEAD}, {SHAPES}, rf AS (SELECT sh.date, feature, {rank_sql('x', 'sh.date, feature')} AS rx, {rank_sql('r', 'sh.date, feature')} AS rw, count(*) OVER (PARTITION BY sh.date, feature) AS n FROM sh JOIN ahead a ON a.date = sh.date AND a.code = sh.code WHERE x IS NOT NULL AND r IS NOT NULL QUALIFY n >= 5),
 fi AS (SELECT feature, round(abs(avg(ic)), 9) AS ic FROM (SELECT date, feature, {corr_sql('rx', 'rw')} AS ic FROM rf GROUP BY 1, 2) GROUP BY 1), fk AS (SELECT *, row_number() OVER (ORDER BY ic DESC, feature) AS k FROM fi)
 SELECT count(*) AS features, arg_min(feature, k) AS best, {r6('max(ic)')} AS best_ic, {r6('quantile_cont(ic, 0.5)')} AS median_ic, {r6('avg(ic) FILTER (k <= 10)')} AS top_ten FROM fk""",
    "a20_against_benchmark": f"""{RANKED}, vb AS (SELECT date, code, coalesce(lead(volume) {LAGS} > 0, false) AS can_buy FROM dense), tp AS (SELECT factor, r.date, count(*) AS bought, avg(fwd) AS top FROM ranked r JOIN vb USING (date, code) WHERE rx / n > 0.8 AND can_buy GROUP BY 1, 2),
 un AS (SELECT factor, date, avg(fwd) AS universe FROM ranked GROUP BY 1, 2), mb AS (SELECT date, lead(level) OVER (ORDER BY date) / level - 1 AS bench FROM (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1))
 SELECT factor, count(*) AS weeks, CAST(sum(bought) AS BIGINT) AS bought, {r6('avg(top - universe) * 52')} AS over_universe, {r6('avg(top - bench) * 52')} AS over_bench FROM tp JOIN un USING (factor, date) JOIN mb USING (date) GROUP BY 1""",
    "a21_verdict_reason": f"""{CLOSEST}, vd AS (SELECT factor, CASE WHEN t IS NULL THEN 'broken' WHEN max_corr >= 0.7 THEN 'copy' WHEN t <= -2 THEN 'backwards' WHEN abs(t) < 2 THEN 'weak' WHEN stable < 0.6 THEN 'unstable' WHEN net <= 0 THEN 'costly' WHEN t >= 3 AND net >= 0.03 AND hit_rate >= 0.55 THEN 'star' ELSE 'keep' END AS verdict, closest FROM judged LEFT JOIN closest USING (factor))
 SELECT factor, verdict, CASE verdict """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " END || CASE WHEN verdict = 'copy' THEN ': ' || closest ELSE '' END AS reason FROM vd",
    "a22_round_statistics": f"""{REV}, md AS (SELECT researcher, arm, round, {r6('abs(ic)')} AS median_ic FROM (SELECT *, row_number() OVER (PARTITION BY researcher, arm, round ORDER BY abs(ic), id) AS m, count(*) OVER (PARTITION BY researcher, arm, round) AS k FROM rs WHERE scored) WHERE m = k // 2 + 1)
 SELECT g.*, median_ic FROM (SELECT researcher, arm, round, count(*) AS proposed, {_pct('scored')} AS valid_pct, count(CASE WHEN scored THEN 1 END) AS scored, count(CASE WHEN useful THEN 1 END) AS useful, {_pct('useful')} AS useful_pct, count(CASE WHEN verdict = 'star' THEN 1 END) AS stars, """ + ", ".join(f"""{_pct(f"verdict = '{v}'")} AS {v}_pct""" for v in ("backwards", "copy", "costly", "broken")) + f", {r6('max(CASE WHEN useful THEN net END)')} AS best_net FROM rs GROUP BY 1, 2, 3) g LEFT JOIN md USING (researcher, arm, round)",
    "a23_lessons": f"""{REV}, ct AS (SELECT researcher, category, count(*) AS n, count(CASE WHEN verdict = 'backwards' THEN 1 END) AS back, count(CASE WHEN useful THEN 1 END) AS good FROM rs WHERE scored GROUP BY 1, 2),
 sn AS (SELECT researcher, turnover, row_number() OVER (PARTITION BY researcher ORDER BY turnover, id) AS m, count(*) OVER (PARTITION BY researcher) AS k FROM rs WHERE scored AND abs(t) >= 2)
 SELECT researcher, category || ': ' || CASE WHEN n >= 2 AND back / n >= 0.5 THEN 'mostly in reverse' ELSE 'works best' END AS lesson FROM ct WHERE n >= 2 AND back / n >= 0.5 OR good >= 2
 UNION ALL SELECT researcher, 'signals change too fast' FROM sn WHERE m = k // 2 + 1 AND turnover > 0.5
 UNION ALL SELECT researcher, 'many break the rules' FROM rs GROUP BY 1 HAVING avg(CASE WHEN verdict = 'broken' THEN 1.0 ELSE 0.0 END) > 0.2 UNION ALL SELECT researcher, 'several restate known factors' FROM rs GROUP BY 1 HAVING count(CASE WHEN verdict = 'copy' THEN 1 END) >= 3""",
    "a24_feedback_against_control": f"{REV}, u AS (SELECT researcher, arm, round, 100 * avg(CASE WHEN useful THEN 1.0 ELSE 0.0 END) AS u FROM rs GROUP BY 1, 2, 3) SELECT researcher, " + ", ".join(f"{r6(e.format(a=a))} AS {a}_{k}" for a in ("feedback", "control") for k, e in {"zero": "max(u) FILTER (arm = '{a}' AND round = 0)", "first": "arg_min(u, round) FILTER (arm = '{a}' AND round > 0)", "last": "arg_max(u, round) FILTER (arm = '{a}' AND round > 0)", "mean": "avg(u) FILTER (arm = '{a}' AND round > 0)"}.items()) + " FROM u GROUP BY 1",
    "j6_two_markets": f"{MK} SELECT factor, " + ", ".join(f"{r6(c)} AS {c}" for c in ("ic_even", "t_even", "ic_odd", "t_odd")) + ", CAST(row_number() OVER (ORDER BY round(least(abs(t_even), abs(t_odd)), 9) DESC, factor) AS INTEGER) AS place FROM tw WHERE ic_even IS NOT NULL AND ic_odd IS NOT NULL",
    "a25_transfer_ranks": f"{MK} SELECT count(*) AS factors, {r6('corr(a, b)')} AS rank_corr FROM (SELECT rank() OVER (ORDER BY round(ic_even, 9)) AS a, rank() OVER (ORDER BY round(ic_odd, 9)) AS b FROM tw)",
    "a27_calibration_summary": f"""WITH c AS (SELECT round(least(n_chars / CAST(5000 AS DOUBLE), 1.0), 6) AS p, CAST(quality AS DOUBLE) AS y FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL),
 e AS (SELECT sum(n * abs(mp - my)) / sum(n) AS ece FROM (SELECT greatest(1, ceil(p * 10)) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM c GROUP BY 1)), o AS (SELECT count(*) AS n, avg(y) AS base, avg((p - y) * (p - y)) AS brier, avg(CASE WHEN p >= 0.6 THEN y END) AS sh, avg(CASE WHEN p >= 0.6 THEN 1.0 ELSE 0.0 END) AS ss FROM c)
 SELECT n, {r6('base')} AS base, {r6('brier')} AS brier, {r6('base * (1 - base)')} AS no_skill, {r6('1 - brier / (base * (1 - base))')} AS skill, {r6('ece')} AS ece, {r6('sh')} AS sure_hits, {r6('ss')} AS sure_share FROM o, e""",
    "a28_prediction_ic": f"""{WITH}, {AHEAD}, x AS (SELECT b.date, {rank_sql('volume', 'b.date')} AS a, {rank_sql('r', 'b.date')} AS c FROM bars b JOIN ahead h ON h.date = b.date AND h.code = b.code WHERE r IS NOT NULL), i AS (SELECT * FROM (SELECT date, {corr_sql('a', 'c')} AS ic FROM x GROUP BY 1) WHERE ic IS NOT NULL)
 SELECT count(*) AS weeks, {r6('avg(ic)')} AS ic, {r6('avg(ic) / stddev_samp(ic) * sqrt(count(*))')} AS t FROM i""",
    "a30_importance": f"{WIC}, g AS (SELECT factor, {OWN} AS maker, sum(abs(ic)) AS gain FROM wic GROUP BY 1, 2) SELECT factor, maker, {r6('gain / sum(gain) OVER ()')} AS share, {r6('sum(gain) OVER (PARTITION BY maker) / sum(gain) OVER ()')} AS maker_share FROM g",
    "j18_owner_split": f"{BA} SELECT label, factor, mine, weeks_before, weeks_after, {r6('before')} AS before, {r6('after')} AS after FROM ba",
    "a35_leakage": f"{LK} SELECT label, factors, weeks_before, weeks_after, status, {r6('''CASE WHEN status LIKE '%signal' OR status = 'MEMORY SIGNAL' THEN own - placebo END''')} AS extra_drop, {r6('''CASE WHEN status LIKE '%signal' OR status = 'MEMORY SIGNAL' THEN (own - placebo) / sqrt(v) END''')} AS z FROM ls",
    "a57_robustness": f"""{WITH}, mv AS (SELECT date, code, lead(open, 6) {LAGS} / lead(open, 1) {LAGS} - 1 AS r, unnest(['move3', 'move2', 'move4', 'move6']) AS feature, unnest([close / lag(close, 3) {LAGS}, close / lag(close, 2) {LAGS}, close / lag(close, 4) {LAGS}, close / lag(close, 6) {LAGS}]) AS x FROM dense),
 rk AS (SELECT date, feature, {rank_sql('x', 'date, feature')} AS rx, {rank_sql('r', 'date, feature')} AS rw, count(*) OVER (PARTITION BY date, feature) AS n FROM mv WHERE x IS NOT NULL AND r IS NOT NULL QUALIFY n >= 5), ic AS (SELECT date, feature, {corr_sql('rx', 'rw')} AS ic FROM rk GROUP BY 1, 2),
 t AS (SELECT feature, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t FROM ic GROUP BY 1), h AS (SELECT count(CASE WHEN sign(v.t) = sign(b.t) AND abs(v.t) >= 0.5 * abs(b.t) THEN 1 END) AS held, count(*) AS tried, max(b.t) AS t0 FROM t v, t b WHERE b.feature = 'move3' AND v.feature != 'move3')
 SELECT held, tried, {r6('t0')} AS t0, CASE WHEN held * 3 >= 2 * tried THEN 'robust' ELSE 'fragile' END AS status FROM h""",
    "a59_distinct_counts": "SELECT count(DISTINCT l_suppkey) AS codes, count(DISTINCT l_partkey) AS parts, count(DISTINCT date_trunc('week', l_shipdate)) AS weeks FROM lineitem",
    "j3_market_on_rows": f"{WITH}, mk AS (SELECT date, level / lag(level, 4) OVER (ORDER BY date) - 1 AS m FROM (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1)) SELECT date, code, {r6('m')} AS mkt_ret4 FROM bars LEFT JOIN mk USING (date)",
    "j4_label_alignment": f"{WITH}, {AHEAD} SELECT b.date, b.code, {r6('b.close / b.open')} AS feature, r > 0 AS y FROM bars b LEFT JOIN ahead a ON a.date = b.date AND a.code = b.code",
    "j5_predictions_with_outcomes": f"{WITH}, {AHEAD}, x AS (SELECT b.date, CASE WHEN high > low THEN (close - low) / (high - low) END AS p, r FROM bars b JOIN ahead a ON a.date = b.date AND a.code = b.code) SELECT date, count(*) AS pairs, {r6('avg(p)')} AS p, {r6('avg(r)')} AS r FROM x WHERE p IS NOT NULL AND r IS NOT NULL GROUP BY 1",
    "j13_closest_feature": f"""{RANKED}, {SHAPES}, kn AS (SELECT date, code, feature, {rank_sql('x', 'date, feature')} AS ry FROM sh WHERE x IS NOT NULL), dc AS (SELECT factor, feature, ranked.date, {corr_sql('rx', 'ry')} AS c FROM ranked JOIN kn USING (date, code) GROUP BY 1, 2, 3),
 ec AS (SELECT factor, feature, round(abs(avg(c)), 6) AS c FROM dc GROUP BY 1, 2) SELECT factor, max(c) AS max_corr, arg_max(feature, (c, feature)) AS closest FROM ec GROUP BY 1""",
    "j14_priority": f"""WITH r AS (SELECT l_partkey, max(l_extendedprice / l_quantity) FILTER (l_returnflag = 'R') AS ret, max(l_extendedprice / l_quantity) FILTER (l_returnflag = 'N') AS op FROM lineitem GROUP BY 1)
 SELECT p_partkey AS l_partkey, {r6('coalesce(ret, op, p_retailprice)')} AS price, CASE WHEN ret IS NOT NULL THEN 'returned' WHEN op IS NOT NULL THEN 'open' ELSE 'list' END AS source FROM part LEFT JOIN r ON r.l_partkey = p_partkey""",
    "j16_two_sources": "SELECT c_name, CASE WHEN max(CASE WHEN c_acctbal > 6000 THEN 1 ELSE 0 END) = 1 THEN 'shortlist' ELSE 'useful' END AS source FROM customer WHERE c_acctbal > 6000 OR c_mktsegment = 'BUILDING' GROUP BY 1",
    "t1_monthly_universe": f"""{WITH}, mo AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, round(sum(value), 2) AS value FROM bars GROUP BY 1, 2), tp AS (SELECT month, code, CAST(row_number() OVER (PARTITION BY month ORDER BY value DESC, code) AS INTEGER) AS k FROM mo QUALIFY k <= 20 AND count(*) OVER (PARTITION BY month) >= 10)
 SELECT date, code, k FROM (SELECT DISTINCT date FROM bars) d JOIN tp ON CAST(date_trunc('month', date) AS DATE) = CAST(month + INTERVAL 1 MONTH AS DATE)""",
    "w45_dispersion": f"{WITH} SELECT date, count(*) AS names, {r6('stddev_samp(r)')} AS dispersion FROM (SELECT date, close / lag(close, 4) {LAGS} - 1 AS r FROM dense) WHERE r IS NOT NULL GROUP BY 1",
    "w49_book_alpha": f"{bk.WEEKS} SELECT variant, date, {r6('CASE WHEN count(*) OVER z = 52 THEN regr_intercept(net, universe) OVER z * 52 END')} AS alpha FROM kw WINDOW z AS (PARTITION BY variant ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)",
}


FAMILY = "roc ma std beta rsqr resi max min qtlu qtld rank rsv imax imin imxd corr cord cntp cntn cntd sump sumn sumd vma vstd wvma vsump vsumn vsumd".split()


def _features_sql() -> str:
    from crosspanel.plans.panel_queries import rolling_sql

    names = FAMILY
    inner = rolling_sql(5).replace(", 4) + 0.0 AS", ", 9) + 0.0 AS").replace(" + 1e-9, 9)", ", 9)")
    cut = inner.rindex("SELECT date, code,")
    head, select = inner[:cut], inner[cut:]
    wide = select.replace(" FROM y", " FROM y WHERE close IS NOT NULL")
    return f"{head}, {SHAPES}, ro AS ({wide}), fx AS (SELECT * FROM sh WHERE x IS NOT NULL UNION ALL SELECT * FROM (SELECT date, code, unnest([{', '.join(repr(k + '5') for k in names)}]) AS feature, unnest([{', '.join(chr(34) + k + chr(34) for k in names)}]) AS x FROM ro) WHERE x IS NOT NULL AND NOT isnan(x))"


SQL["w38_feature_matrix"] = f"{_features_sql()} SELECT feature, count(CASE WHEN abs(x) < 'infinity'::DOUBLE THEN 1 END) AS n, round(avg(CAST(CAST(x AS FLOAT) AS DOUBLE)), 3) AS mean, round(CAST(max(CAST(x AS FLOAT)) AS DOUBLE), 1) AS most FROM fx GROUP BY 1"
SQL["w39_all_ranks"] = f"{_features_sql()}, ry AS (SELECT feature, code, ({rank_sql('x', 'date, feature')}) / count(*) OVER (PARTITION BY date, feature) - 0.5 AS v FROM fx) SELECT feature, count(*) AS n, {r6('avg(v * (code % 7))')} AS \"check\", {r6('max(v)')} AS most FROM ry GROUP BY 1"
