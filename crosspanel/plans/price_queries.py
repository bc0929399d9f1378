"""Queries of traded prices: ids, corporate actions, factors, limits, calendars and cuts in time, each with its SQL.

The panel is the weekly one with gaps, smoothed over eight weeks, and with one event planted in each code, by its number:
a split with a new id, free shares, a spin-off, a real fall within the day, a new id alone, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import actions as a
from crosspanel.plans.factor_queries import LAGS, WITH
from crosspanel.plans.panel_queries import R4, r4
from crosspanel.sources import panel as p

SINCE = "1998-08-24"
CUT = "1999-12-31"


def traded(spark, d) -> DataFrame:
    """date, code, t, symbol, isin, open, high, low, close, volume and value of each week; weeks without a trade have nulls."""
    by, kind, event = f.by_code(), F.col("code") % 6, 150 + F.col("code") % 100
    x = p.dense_bars(spark, d)
    x = x.withColumn("smooth", F.when(F.col("close").isNotNull(), F.avg("close").over(by.rowsBetween(-7, 0))))
    before = F.last("smooth", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("begin", F.coalesce((F.col("smooth") + 2 * before) / 3, F.col("smooth")))
    size = F.when(kind == 0, 5.0).when(kind == 1, 2.0).when(kind == 2, 1 / 0.55).when(kind == 3, 2.0).otherwise(1.0)
    parts = F.when(F.col("t") >= event, size).otherwise(1.0)
    opened = F.when((kind == 3) & (F.col("t") == event), F.col("begin")).otherwise(F.col("begin") / parts)
    close, volume = F.col("smooth") / parts, F.col("volume") * parts
    new_id = kind.isin(0, 5) & (F.col("t") > event)
    start = F.when(F.col("code") % 8 == 5, "INF").otherwise("INE")
    isin = F.concat(start, F.lpad(F.col("code").cast("string"), 6, "0"), F.when(new_id, "B").otherwise("A"))
    board = F.when(F.col("code") % 5 == 0, "688").when(F.col("code") % 5 == 1, "300").otherwise("600")
    made = x.select("date", "code", "t", F.concat(board, F.col("code").cast("string")).alias("symbol"), F.when(F.col("close").isNotNull(), isin).alias("isin"), opened.alias("open"), close.alias("close"), volume.alias("volume"))
    return made.withColumns({"high": F.greatest("open", "close"), "low": F.least("open", "close"), "value": F.col("close") * F.col("volume")})


def overrides(spark, d) -> DataFrame:
    """What people decided: every eighteenth code has its weeks of 1997 kept, and another one each week of 1998 adjusted, in part by a ratio."""
    week = p.bars(spark, d).select("date", "code").distinct()
    keep = week.where("code % 18 = 3 and year(date) = 1997").select("code", "date", F.lit("keep").alias("action"), F.lit(None).cast("double").alias("ratio"))
    adjust = week.where("code % 18 = 7 and date >= '1998-06-01' and date < '1998-07-01'")
    return keep.union(adjust.select("code", "date", F.lit("adjust"), F.when(F.month("date") % 2 == 0, 1.5)))


def detected(spark, d) -> DataFrame:
    return a.corporate_actions(traded(spark, d), overrides(spark, d))


def priced(spark, d) -> DataFrame:
    return a.price_factor(traded(spark, d), detected(spark, d))


def w54_corporate_actions(spark, d):
    numbers = ("move", "gap", "ratio", "match", "value_x")
    return detected(spark, d).select("date", "code", "kind", *(R4(F.col(c)).alias(c) for c in numbers), "near_change", "adjusted", "note")


def w55_backward_factor(spark, d):
    return priced(spark, d).select("date", "code", R4(F.col("factor")).alias("factor"))


def w52_id_change(spark, d):
    """Weeks within ten of a new id; rounding plays no part."""
    return a.id_changed_nearby(traded(spark, d)).select("date", "code", F.col("near_change"))


def j11_override_lookup(spark, d):
    """Each decision beside the event it was made on."""
    x = detected(spark, d).select("code", "date", "kind", "adjusted")
    return overrides(spark, d).join(x, ["code", "date"], "left").select("code", "date", "action", "kind", "adjusted", R4(F.col("ratio")).alias("ratio"))


def p2_companies_only(spark, d):
    """Rows whose id is that of a company, or missing."""
    x = traded(spark, d).where(F.col("isin").isNull() | F.col("isin").startswith("INE"))
    return x.groupBy("date").agg(F.count("*").alias("rows"), F.count("close").alias("traded"))


def p11_adjusted_columns(spark, d):
    x = a.adjusted(priced(spark, d))
    return x.where("close is not null").select("date", "code", *(R4(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap", "raw_close")))


def p4_raw_prices(spark, d):
    x = a.raw_moves(a.adjusted(priced(spark, d)).drop("raw_close"))
    return x.select("date", "code", *(R4(F.col(c)).alias(c) for c in ("raw_close", "raw_open", "chg", "raw_chg")))


def p6_daily_limit(spark, d):
    x = traded(spark, d).select("symbol", "date", a.daily_limit(F.col("symbol"), F.col("date"), SINCE).alias("limit"))
    return x.groupBy("symbol", "limit").agg(F.min("date").alias("since"), F.count("*").alias("rows"))


def p7_limit_days(spark, d):
    x = a.raw_moves(a.adjusted(priced(spark, d)).drop("raw_close"))
    up, down = a.at_limit(F.col("raw_chg"), a.daily_limit(F.col("symbol"), F.col("date"), SINCE))
    return x.where("raw_chg is not null").select("date", "code", up.alias("limit_up"), down.alias("limit_down"))


def p8_tradable(spark, d):
    x = a.tradable(traded(spark, d), a.daily_limit(F.col("symbol"), F.col("date"), SINCE))
    return x.select("date", "code", "can_buy", "can_sell")


def a2_data_quality(spark, d):
    """One row: missing, suspended and large moves, codes, and the first and last level of the market."""
    x = priced(spark, d).withColumn("last", a.previous_close())
    share = lambda e: R4(100 * F.avg(e.cast("double")))
    level = x.groupBy("date").agg(F.sum("volume").alias("level")).agg(F.min_by("level", "date").alias("first_level"), F.max_by("level", "date").alias("last_level"))
    large = F.abs(F.col("close") / F.col("last") - 1) > 0.25
    one = x.agg(
        F.count("*").alias("rows"), F.count_distinct("code").alias("codes"), share(F.col("close").isNull()).alias("missing_pct"),
        share(F.coalesce("volume", F.lit(0.0)) <= 0).alias("suspended_pct"), F.count_if(large).alias("large_moves"), F.min("date").alias("begin"), F.max("date").alias("end"),
    )
    return one.join(level.select(*(R4(F.col(c)).alias(c) for c in level.columns)), how="cross")  # one row each


def a3_moves_by_year(spark, d):
    """By year: falls and rises of a fifth and more, events by kind, and the share of weeks whose vwap lies within the range."""
    x = a.adjusted(priced(spark, d)).withColumn("move", F.col("raw_close") / F.last("raw_close", ignorenulls=True).over(a.by_code().rowsBetween(Window.unboundedPreceding, -1)))
    inside = (F.col("value") / F.col("volume") * F.col("factor")).between(F.col("low") * (1 - 1e-9), F.col("high") * (1 + 1e-9))
    years = x.where("close is not null").groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("move") <= 0.8).alias("falls"), F.count_if(F.col("move") >= 1.2).alias("rises"), R4(F.avg(inside.cast("double"))).alias("vwap_inside"))
    events = detected(spark, d).groupBy(F.year("date").alias("year")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("split", "bonus", "other", "kept")))
    zero = F.lit(0).cast("long")
    return years.join(events, "year", "left").select("year", "falls", "rises", "vwap_inside", *(F.coalesce(k, zero).alias(k) for k in ("split", "bonus", "other", "kept")))


def p1_time_cut(spark, d):
    """The cut comes before the labels, so that no label looks past it."""
    x = p.dense_bars(spark, d).where(F.col("date") <= F.to_date(F.lit(CUT)))
    ahead = f.safe_div(F.lead("open", 6).over(f.by_code()), F.lead("open", 1).over(f.by_code())) - 1
    return x.select("date", "code", R4(ahead).alias("fwd"))


def p3_member_mask(spark, d):
    """The close of members only; members are the 20 codes of the most value in the week."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code"))
    return p.bars(spark, d).withColumn("member", rank <= 20).select("date", "code", "member", R4(F.when(F.col("member"), F.col("close"))).alias("close"))


def j2_membership(spark, d):
    """Bars beside membership, missing as false: members were among the 20 of the most value in the week before."""
    bars = p.bars(spark, d)
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code"))
    members = bars.select("date", "code", rank.alias("k")).where("k <= 20").select(F.date_add("date", 7).alias("date"), "code", F.lit(True).alias("member"))
    return bars.join(members, ["date", "code"], "left").select("date", "code", F.coalesce("member", F.lit(False)).alias("member"))


def p10_pivot(spark, d):
    """Value by week and region in columns; the five regions are listed, so that no pass is needed to find them."""
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    sup = p.read(spark, d, "supplier").join(p.read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(p.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = p.bars(spark, d).join(sup.select(F.col("s_suppkey").alias("code"), "r_name"), "code")
    wide = x.groupBy("date").pivot("r_name", names).agg(F.sum("volume"))
    return wide.select("date", *(F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in names))


def p12_scrub(spark, d):
    """Infinite and undefined ratios become null, the others are rounded."""
    x = p.dense_bars(spark, d).select("date", "code", f.safe_div(F.col("high") - F.col("low"), F.col("close") - F.col("open")).alias("v"))
    fine = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.round(F.col("v") + 1e-9, 3) + 0.0)
    return x.select("date", "code", fine.alias("v"))


def calendar(spark, d) -> DataFrame:
    """date, its number t from 0, and n, all in one series."""
    days = p.bars(spark, d).select("date").distinct().withColumn("series", F.lit("all"))
    return days.select("date", "series", (F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1).alias("t"), F.count("*").over(Window.partitionBy("series")).alias("n"))


def p13_even_sample(spark, d):
    """Twelve dates at equal distances, the first and the last among them."""
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor(i * (F.col("n") - 1) / 11)))
    wanted = calendar(spark, d).select("series", "n").distinct().select("series", place.alias("t"))
    return calendar(spark, d).join(F.broadcast(wanted.distinct()), ["series", "t"], "left_semi").select("date")


def p14_rebalance_dates(spark, d):
    """Every fifth date whose holding time ends by the cut."""
    ends = F.lead("date", 6).over(Window.partitionBy("series").orderBy("date"))
    return calendar(spark, d).withColumn("ends", ends).where((F.col("t") % 5 == 0) & (F.col("ends") <= F.to_date(F.lit(CUT)))).select("date", "ends")


def p16_before_month(spark, d):
    """For each month after the first its first date and the date before it, on which is decided."""
    before = F.lag("date").over(Window.partitionBy("series").orderBy("date"))
    x = calendar(spark, d).withColumn("before", before)
    return x.where(F.trunc("date", "MM") != F.trunc("before", "MM")).select(F.trunc("date", "MM").alias("month"), F.col("date").alias("first_date"), F.col("before").alias("decided_on"))


def p19_split_by_known(spark, d):
    """Rows in training, validation and test by the date on which their label is known."""
    known = F.lead("date", 6).over(f.by_code())
    x = p.dense_bars(spark, d).select("date", "code", known.alias("known"))
    part = F.when(F.col("known") < F.lit("1998-01-01").cast("date"), "train").when((F.col("date") >= F.lit("1998-01-01").cast("date")) & (F.col("known") < F.lit("1999-01-01").cast("date")), "valid")
    part = part.when((F.col("date") >= F.lit("1999-01-01").cast("date")) & (F.col("date") < F.lit("2000-01-01").cast("date")), "test")
    return x.withColumn("part", part).where("part is not null").groupBy("part").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("known").alias("last_known"))


def u5_common_calendar(spark, d):
    """The days of the orders on the calendar of the bars: the number of orders of each week, none where it has no order."""
    orders = p.read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date")).agg(F.count("*").alias("orders"))
    return calendar(spark, d).select("date").join(orders, "date", "left").select("date", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"))


def t8_every_nth(spark, d):
    """Every fourth week of the last two years, in order of time, counted from the last week."""
    x = calendar(spark, d).withColumn("back", F.col("n") - 1 - F.col("t"))
    return x.where((F.col("back") < 104) & (F.col("back") % 4 == 0)).select("date", "back").orderBy("date")


CALLS = (
    w54_corporate_actions, w55_backward_factor, w52_id_change, j11_override_lookup, p2_companies_only, p11_adjusted_columns, p4_raw_prices, p6_daily_limit,
    p7_limit_days, p8_tradable, a2_data_quality, a3_moves_by_year, p1_time_cut, p3_member_mask, j2_membership, p10_pivot, p12_scrub, p13_even_sample,
    p14_rebalance_dates, p16_before_month, p19_split_by_known, u5_common_calendar, t8_every_nth,
)
QUERIES = {c.__name__: c for c in CALLS}

PAST = "OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TRADED = f"""{WITH}, smooth AS (SELECT *, CASE WHEN close IS NOT NULL THEN avg(close) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS smooth, 150 + code % 100 AS event, code % 6 AS kind FROM dense),
begun AS (SELECT *, coalesce((smooth + 2 * last_value(smooth IGNORE NULLS) {PAST}) / 3, smooth) AS begin_, CASE WHEN t >= event THEN CASE kind WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 1 / 0.55::DOUBLE WHEN 3 THEN 2.0 ELSE 1.0 END ELSE 1.0 END AS parts FROM smooth),
shares AS (SELECT date, code, t, CASE code % 5 WHEN 0 THEN '688' WHEN 1 THEN '300' ELSE '600' END || code AS symbol,
 CASE WHEN close IS NOT NULL THEN CASE WHEN code % 8 = 5 THEN 'INF' ELSE 'INE' END || lpad(CAST(code AS VARCHAR), 6, '0') || CASE WHEN kind IN (0, 5) AND t > event THEN 'B' ELSE 'A' END END AS isin,
 CASE WHEN kind = 3 AND t = event THEN begin_ ELSE begin_ / parts END AS open, smooth / parts AS close, volume * parts AS volume FROM begun),
traded AS (SELECT *, greatest(open, close) AS high, least(open, close) AS low, close * volume AS value, last_value(close IGNORE NULLS) {PAST} AS last FROM shares),
ids AS (SELECT *, last_value(isin IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS id FROM traded),
changes AS (SELECT *, coalesce(id != lag(id) {LAGS}, false) AS changed FROM ids),
near_ids AS (SELECT *, bool_or(changed) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near_change FROM changes),
overrides AS (SELECT DISTINCT code, date, 'keep' AS action, NULL::DOUBLE AS ratio FROM bars WHERE code % 18 = 3 AND year(date) = 1997
 UNION ALL SELECT DISTINCT code, date, 'adjust', CASE WHEN month(date) % 2 = 0 THEN 1.5::DOUBLE END FROM bars WHERE code % 18 = 7 AND date >= DATE '1998-06-01' AND date < DATE '1998-07-01')"""


def _nearest_sql(move: str, ratios) -> str:
    values = ", ".join(f"{r!r}::DOUBLE" for r in ratios)
    return f"list_sort(list_transform([{values}], lambda r, i: {{'dist': abs(ln(1 / {move}) - ln(r)), 'at': i, 'ratio': r}}))[1]"


ACTIONS = f"""{TRADED}, watched AS (SELECT n.*, close / last AS move, CASE WHEN open > 0 THEN open / last END AS gap, o.action, o.ratio AS its_ratio,
 value / CASE WHEN count(CASE WHEN value > 0 THEN 1 END) OVER v >= 5 THEN quantile_cont(CASE WHEN value > 0 THEN value END, 0.5) OVER v END AS value_x
 FROM near_ids n LEFT JOIN overrides o USING (code, date) WINDOW v AS (PARTITION BY code ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
seen AS (SELECT *, {_nearest_sql('move', a.SPLITS)} AS split, {_nearest_sql('gap', a.BONUSES + a.FEW)} AS opened, {_nearest_sql('move', a.BONUSES + a.FEW)} AS really, {_nearest_sql('move', a.BONUSES)} AS bonus, coalesce(gap <= 0.79, false) AS low_open
 FROM watched WHERE move IS NOT NULL AND (action IS NOT NULL OR move > 0.001 AND (move <= 0.78 OR coalesce(gap <= 0.79, false) OR near_change AND abs(ln(move)) > ln(1.6::DOUBLE)))),
ruled AS (SELECT *, CASE WHEN near_change THEN CASE WHEN split.dist < 0.2 OR NOT low_open THEN {{'k': 'split', 'r': split.ratio, 'ok': split.dist < 0.2}} ELSE {{'k': 'other', 'r': 1 / gap, 'ok': true}} END
 WHEN gap IS NOT NULL THEN CASE WHEN NOT low_open THEN {{'k': 'kept', 'r': really.ratio, 'ok': false}} WHEN opened.dist < 0.05 THEN {{'k': 'bonus', 'r': opened.ratio, 'ok': true}} ELSE {{'k': 'other', 'r': 1 / gap, 'ok': true}} END
 WHEN move <= 0.6 AND bonus.dist < CASE WHEN bonus.ratio < 3 THEN 0.06 ELSE 0.1 END THEN {{'k': 'bonus', 'r': bonus.ratio, 'ok': true}} WHEN move <= 0.6 THEN {{'k': 'other', 'r': 1 / move, 'ok': true}} ELSE {{'k': 'bonus', 'r': bonus.ratio, 'ok': false}} END AS rule FROM seen),
acts AS (SELECT date, code, rule.k AS kind, move, gap, CASE WHEN action = 'adjust' THEN coalesce(its_ratio, rule.r) ELSE rule.r END AS ratio, value_x, near_change, CASE action WHEN 'keep' THEN false WHEN 'adjust' THEN true ELSE rule.ok END AS adjusted, CASE action WHEN 'keep' THEN 'override: real price move' WHEN 'adjust' THEN 'override: adjust' ELSE '' END AS note FROM ruled),
priced AS (SELECT t.*, coalesce(product(coalesce(1 / CASE WHEN e.adjusted THEN e.ratio END, 1.0)) OVER (PARTITION BY t.code ORDER BY t.t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1.0) AS factor FROM traded t LEFT JOIN acts e ON e.code = t.code AND e.date = t.date)"""
WIDE = f"CASE WHEN symbol LIKE '688%' OR symbol LIKE '300%' AND date >= DATE '{SINCE}' THEN 0.2::DOUBLE ELSE 0.1 END"
RAW = f"""{ACTIONS}, raws AS (SELECT *, close * factor / factor AS raw_close, open * factor / factor AS raw_open, close * factor AS adj FROM priced),
moved AS (SELECT *, adj / lag(adj) {LAGS} - 1 AS chg, raw_close / lag(raw_close) {LAGS} - 1 AS raw_chg FROM raws)"""
CAL = f"{WITH}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"
SQL = {
    "w54_corporate_actions": f"{ACTIONS} SELECT date, code, kind, {r4('move')} AS move, {r4('gap')} AS gap, {r4('ratio')} AS ratio, {r4('abs(ln(move * ratio))')} AS match, {r4('value_x')} AS value_x, near_change, adjusted, note FROM acts",
    "w55_backward_factor": f"{ACTIONS} SELECT date, code, {r4('factor')} AS factor FROM priced",
    "w52_id_change": f"{TRADED} SELECT date, code, near_change FROM near_ids",
    "j11_override_lookup": f"{ACTIONS} SELECT o.code, o.date, o.action, a.kind, a.adjusted, {r4('o.ratio')} AS ratio FROM overrides o LEFT JOIN acts a ON a.code = o.code AND a.date = o.date",
    "p2_companies_only": f"{TRADED} SELECT date, count(*) AS rows, count(close) AS traded FROM traded WHERE isin IS NULL OR isin LIKE 'INE%' GROUP BY 1",
    "p11_adjusted_columns": f"{ACTIONS} SELECT date, code, " + ", ".join(f"{r4(f'{c} * factor')} AS {c}" for c in ("open", "high", "low", "close")) + f", {r4('volume / factor')} AS volume, {r4('CASE WHEN volume / factor > 0 THEN value / (volume / factor) END')} AS vwap, {r4('close')} AS raw_close FROM priced WHERE close IS NOT NULL",
    "p4_raw_prices": f"{RAW} SELECT date, code, " + ", ".join(f"{r4(c)} AS {c}" for c in ("raw_close", "raw_open", "chg", "raw_chg")) + " FROM moved",
    "p6_daily_limit": f"{TRADED} SELECT symbol, {WIDE} AS \"limit\", min(date) AS since, count(*) AS rows FROM traded GROUP BY 1, 2",
    "p7_limit_days": f"{RAW} SELECT date, code, raw_chg >= {WIDE} - 0.002::DOUBLE AS limit_up, raw_chg <= -({WIDE}) + 0.002::DOUBLE AS limit_down FROM moved WHERE raw_chg IS NOT NULL",
    "p8_tradable": f"""{TRADED}, g AS (SELECT *, open / last - 1 AS gap, close / last - 1 AS to_last, {WIDE} AS lim, coalesce(volume > 0, false) AS active FROM traded)
 SELECT date, code, active AND NOT coalesce(gap >= lim - 0.002::DOUBLE, false) AND NOT coalesce(high = low AND abs(to_last) >= 0.019::DOUBLE AND to_last > 0, false) AS can_buy,
 active AND NOT coalesce(gap <= -lim + 0.002::DOUBLE, false) AND NOT coalesce(high = low AND abs(to_last) >= 0.019::DOUBLE AND to_last < 0, false) AS can_sell FROM g""",
    "a2_data_quality": f"""{ACTIONS}, lv AS (SELECT date, sum(volume) AS level FROM priced GROUP BY 1)
 SELECT count(*) AS rows, count(DISTINCT code) AS codes, {r4('100 * avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_pct, {r4('100 * avg(CASE WHEN coalesce(volume, 0) <= 0 THEN 1.0 ELSE 0.0 END)')} AS suspended_pct,
 count(CASE WHEN abs(close / last - 1) > 0.25 THEN 1 END) AS large_moves, min(date) AS begin, max(date) AS "end", {r4('(SELECT arg_min(level, date) FROM lv)')} AS first_level, {r4('(SELECT arg_max(level, date) FROM lv)')} AS last_level FROM priced""",
    "a3_moves_by_year": f"""{ACTIONS}, ys AS (SELECT CAST(year(date) AS INTEGER) AS year, count(CASE WHEN close / last <= 0.8 THEN 1 END) AS falls, count(CASE WHEN close / last >= 1.2 THEN 1 END) AS rises,
 {r4('avg(CASE WHEN value / (volume / factor) * factor BETWEEN low * factor * (1 - 1e-9) AND high * factor * (1 + 1e-9) THEN 1.0 ELSE 0.0 END)')} AS vwap_inside FROM priced WHERE close IS NOT NULL GROUP BY 1),
 es AS (SELECT CAST(year(date) AS INTEGER) AS year, """ + ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS {k}" for k in ("split", "bonus", "other", "kept")) + " FROM acts GROUP BY 1) SELECT year, falls, rises, vwap_inside, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in ("split", "bonus", "other", "kept")) + " FROM ys LEFT JOIN es USING (year)",
    "p1_time_cut": f"{WITH}, cut AS (SELECT * FROM dense WHERE date <= DATE '{CUT}') SELECT date, code, {r4(f'lead(open, 6) {LAGS} / lead(open, 1) {LAGS} - 1')} AS fwd FROM cut",
    "p3_member_mask": f"{WITH}, m AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) <= 20 AS member FROM bars) SELECT date, code, member, {r4('CASE WHEN member THEN close END')} AS close FROM m",
    "j2_membership": f"{WITH}, m AS (SELECT CAST(date + 7 AS DATE) AS date, code FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, code) <= 20) SELECT date, code, EXISTS (SELECT 1 FROM m WHERE m.date = bars.date AND m.code = bars.code) AS member FROM bars",
    "p10_pivot": f"{WITH} SELECT date, " + ", ".join(f"sum(volume) FILTER (r_name = '{n}') AS {n.lower().replace(' ', '_')}" for n in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM bars JOIN supplier ON s_suppkey = code JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "p12_scrub": f"{WITH} SELECT date, code, round(CASE WHEN abs(close - open) > 1e-12 THEN (high - low) / (close - open) END + 1e-9, 3) + 0.0 AS v FROM dense",
    "p13_even_sample": f"{CAL} SELECT date FROM cal WHERE t IN (SELECT CAST(floor(i * (n - 1) / 11.0) AS BIGINT) FROM range(0, 12) r(i), (SELECT DISTINCT n FROM cal))",
    "p14_rebalance_dates": f"{CAL} SELECT date, ends FROM (SELECT date, t, lead(date, 6) OVER (ORDER BY date) AS ends FROM cal) WHERE t % 5 = 0 AND ends <= DATE '{CUT}'",
    "p16_before_month": f"{CAL} SELECT CAST(date_trunc('month', date) AS DATE) AS month, date AS first_date, before AS decided_on FROM (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM cal) WHERE date_trunc('month', date) != date_trunc('month', before)",
    "p19_split_by_known": f"""{WITH}, k AS (SELECT date, lead(date, 6) {LAGS} AS known FROM dense), s AS (SELECT *, CASE WHEN known < DATE '1998-01-01' THEN 'train' WHEN date >= DATE '1998-01-01' AND known < DATE '1999-01-01' THEN 'valid' WHEN date >= DATE '1999-01-01' AND date < DATE '2000-01-01' THEN 'test' END AS part FROM k)
 SELECT part, count(*) AS rows, min(date) AS "first", max(known) AS last_known FROM s WHERE part IS NOT NULL GROUP BY 1""",
    "u5_common_calendar": f"{CAL}, o AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, count(*) AS orders FROM orders GROUP BY 1) SELECT date, coalesce(orders, 0) AS orders FROM cal LEFT JOIN o USING (date)",
    "t8_every_nth": f"{CAL} SELECT date, n - 1 - t AS back FROM cal WHERE n - 1 - t < 104 AND (n - 1 - t) % 4 = 0",
}
