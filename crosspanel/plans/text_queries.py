"""Queries of texts, replies, libraries of factors and small lists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.plans.book_queries import R6, r6
from crosspanel.plans.factor_queries import WITH
from crosspanel.sources import panel as p

#: Names of the screen's rule families and their patterns, written for the invented words of the tables.
RULES = (
    ("advice-word", r" (the|der|los) (and|und|que) "),
    ("price-call", r" \d{3,} "),
    ("promise", r" (worthless|idiot|moron|scum|clown|disgusting)[ .,]"),
    ("prediction", r" will (?:surely |definitely )?(?:rise|fall) "),
    ("secret", r"(?:token|password|secret)\s*[:=]"),
)
DISCLAIMER = "license"
YOUNG_DAYS = 30
#: Categories of factors, and families of features with what they say.
CATEGORIES = ("momentum", "reversal", "volume", "volatility")
FAMILIES = {"MA": "mean price over {w} weeks", "STD": "spread of prices over {w} weeks", "ROC": "change over {w} weeks", "CORR": "link of price and volume over {w} weeks"}


def screened(spark, d) -> DataFrame:
    """doc_id and problems: a list of "rule: what was met", with the rules on data age, names in use and the disclaimer.

    A document's data is as old as its id in days from the first; texts of source 'web' are for learners, who must not see young data.
    """
    x = p.read(spark, d, "documents").select("doc_id", "source", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    met = [F.when(F.regexp_extract("low", pattern, 0) != "", F.concat(F.lit(f"{rule}: "), F.regexp_extract("low", pattern, 0))) for rule, pattern in RULES]
    learners = F.coalesce(F.col("source"), F.lit("")).rlike("^[a-m]")
    age = F.when(learners & (F.col("doc_id") % 90 < YOUNG_DAYS), F.concat(F.lit("data-age: "), (F.col("doc_id") % 90).cast("string")))
    disclaimer = F.when(~learners & ~F.contains("low", F.lit(DISCLAIMER)), F.lit("disclaimer: missing"))
    names = current_names(spark, d)
    # words of a text meet the names in use by an equality join
    words = x.where(learners).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"[a-z]+"), 0))).alias("name"))
    named = words.join(names, "name").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("names"))  # of at most 5 names
    pick = F.concat(F.lit("current-pick: "), "names")
    return x.join(named, "doc_id", "left").select("doc_id", F.array_compact(F.array(*met, age, pick, disclaimer)).alias("problems"))


def current_names(spark, d) -> DataFrame:
    """Five names in a current book: the regions' first words, and what follows from them."""
    return p.read(spark, d, "region").select(F.substring(F.lower("r_name"), 1, 2).alias("name")).distinct()


def x3_rule_screen(spark, d):
    return screened(spark, d).select("doc_id", F.array_join("problems", "; ").alias("problems"), F.size("problems").alias("n"))


def x4_report_routing(spark, d):
    """Reports that may go out and those held back, by the first problem."""
    route = F.when(F.size("problems") == 0, "clean").otherwise("blocked")
    first = F.coalesce(F.split_part(F.get("problems", F.lit(0)), F.lit(":"), F.lit(1)), F.lit("none"))
    return screened(spark, d).groupBy(route.alias("route"), first.alias("rule")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def replies(spark, d) -> DataFrame:
    """Replies of a model made from the conversations: a list of factors as JSON, some after a thought, some in a fence, some cut off."""
    x = p.read(spark, d, "conversations").where("role = 'assistant'")
    name = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 40), r'["\\\n]', " ")
    item = lambda k: F.format_string('{"name": "%s %d", "category": "%s", "expression": "Mean(close, %d)", "hypothesis": "h%d"}', name, F.lit(k), F.when((F.col("conv_id") + k) % 5 == 0, "unheard").otherwise(F.element_at(F.array(*map(F.lit, CATEGORIES)), ((F.col("conv_id") + k) % 4 + 1).cast("int"))), ((F.col("conv_id") * 7 + k * 13) % 70).cast("int"), F.lit(k))
    body = F.concat(F.lit('{"factors": ['), F.concat_ws(", ", item(1), item(2), item(3)), F.lit("]}"))
    kind = F.col("conv_id") % 4
    text = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("<think>{not this}</think>\n"), body)).when(kind == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.expr("substring(body, 1, length(body) - 60)"))
    return x.withColumn("body", body).select("conv_id", "turn", text.alias("reply"))


ITEM = "struct<name: string, category: string, expression: string, hypothesis: string>"


def parsed(reply: DataFrame) -> DataFrame:
    """`reply` with items and truncated: thoughts and fences go, the object is parsed whole, or its complete items are saved where it was cut off."""
    plain = F.regexp_replace(F.regexp_replace("reply", r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    whole = F.from_json(F.regexp_extract("plain", r"(?s)\{.*\}", 0), f"factors array<{ITEM}>")["factors"]
    saved = F.transform(F.regexp_extract_all("plain", F.lit(r"\{[^{}]*\}"), 0), lambda t: F.from_json(t, ITEM))
    x = reply.withColumn("plain", plain).withColumn("whole", whole)
    # a list that was cut off does not end as JSON does
    cut = ~F.col("plain").rlike(r"\}\s*$")
    return x.select("conv_id", "turn", F.when(cut, saved).otherwise(F.coalesce("whole", saved)).alias("items"), cut.alias("truncated"))


def x1_reply_json(spark, d):
    return parsed(replies(spark, d)).select("conv_id", "turn", F.size("items").alias("n"), "truncated", F.get("items", F.lit(0))["expression"].alias("first"))


def library(spark, d) -> DataFrame:
    """Factor records of all replies: clipped texts, a known category, status valid, invalid (window below 2 or above 60) or duplicate (the first stays), and an id in order."""
    x = parsed(replies(spark, d)).select("conv_id", "turn", F.posexplode("items").alias("at", "item")).select("conv_id", "turn", "at", "item.*")
    x = x.withColumn("window", F.regexp_extract("expression", r",\s*(\d+)\s*\)", 1).cast("int")).withColumn("series", F.lit("all"))
    valid = F.col("window").between(2, 60)
    first = F.row_number().over(Window.partitionBy("expression").orderBy("conv_id", "turn", "at"))
    x = x.withColumn("status", F.when(~valid, "invalid").when(first == 1, "valid").otherwise("duplicate"))
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("other")
    return x.select("conv_id", "turn", "at", F.substring("name", 1, 60).alias("name"), category.alias("category"), "expression", F.substring("hypothesis", 1, 300).alias("hypothesis"), "window", "status")


def x2_library_ingest(spark, d):
    """Valid factors with their ids, which go on from those of the library; one row for each expression, so few."""
    new = library(spark, d).where("status = 'valid'").withColumn("series", F.lit("all"))
    number = F.row_number().over(Window.partitionBy("series").orderBy("conv_id", "turn", "at")) + 12
    return new.select(F.format_string("F%04d", number).alias("id"), "name", "category", "expression", "window")


def d6_reply_rows(spark, d):
    """Many factor rows from one reply: counts by category and status."""
    return library(spark, d).groupBy("category", "status").agg(F.count("*").alias("n"))


def u2_distinct_by_key(spark, d):
    """The first and the last reply in which each expression stands."""
    w = Window.partitionBy("expression")
    order = ("conv_id", "turn", "at")
    x = library(spark, d).withColumns({"a": F.row_number().over(w.orderBy(*order)), "z": F.row_number().over(w.orderBy(*map(F.desc, order)))})
    return x.groupBy("expression").agg(F.max(F.when(F.col("a") == 1, F.col("conv_id"))).alias("first_conv"), F.max(F.when(F.col("z") == 1, F.col("conv_id"))).alias("last_conv"))


def x6_window_variants(spark, d):
    """Each valid factor with its window at half, one and a half times and double, within 2 and 60; what is the same goes once."""
    scaled = F.transform(F.array(*map(F.lit, (0.5, 1.5, 2.0))), lambda k: F.struct(k.alias("scale"), F.greatest(F.lit(2), F.least(F.lit(60), F.bround(F.col("window") * k).cast("int"))).alias("to")))
    x = library(spark, d).where("status = 'valid'").select("expression", "window", F.explode(scaled).alias("v")).where("v.to != window")
    x = x.groupBy("expression", F.col("v.to").alias("to")).agg(F.min("v.scale").alias("scale"))
    return x.select("expression", R6(F.col("scale")).alias("scale"), F.regexp_replace("expression", F.lit(r",\s*\d+\s*\)"), F.concat(F.lit(", "), F.col("to").cast("string"), F.lit(")"))).alias("variant"))


def x5_explain(spark, d):
    """A sentence for each of the features of a week's top codes: family and window from the name, wording from the rank."""
    x = p.bars(spark, d).select("date", "code", F.concat(F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("code") % 4 + 1).cast("int")), (F.col("code") % 5 * 5 + 5).cast("string")).alias("feature"), F.percent_rank().over(Window.partitionBy("date").orderBy("value", "code")).alias("q"))
    meaning = F.create_map(*(F.lit(e) for kv in FAMILIES.items() for e in kv))
    family, window = F.regexp_extract("feature", r"^([A-Z]+)(\d+)$", 1), F.regexp_extract("feature", r"^([A-Z]+)(\d+)$", 2)
    words = F.replace(F.coalesce(F.element_at(meaning, family), F.lit("something else over {w} weeks")), F.lit("{w}"), window)
    place = F.when(F.col("q") >= 0.9, "among the highest").when(F.col("q") <= 0.1, "among the lowest").otherwise("in the middle")
    return x.select("date", "code", F.concat_ws(" ", F.initcap(F.substring(words, 1, 1)), F.substring(words, 2, 100), F.lit("is"), place).alias("sentence"))


def x7_retrieval(spark, d):
    """For each question (the first turn of a conversation) the last fifteen earlier events whose type stands among its words of four letters and more; without any, the last ten events."""
    q = p.read(spark, d, "conversations").where("turn = 0").select("conv_id", F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+"), lambda w: F.length(w) > 3)).alias("words"))
    # two of three questions ask for a kind of events by its name
    asked = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("errors"))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("clicks"), F.lit("purchases"))).otherwise(F.expr("cast(array() as array<string>)"))
    q = q.withColumn("words", F.array_union("words", asked))
    # the types are few; a question's words choose among the last events of each type, which are found once
    e = p.read(spark, d, "events").select("event_id", "ts", "event_type")
    by_type = e.withColumn("k", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 15")
    hits = q.select("conv_id", F.explode("words").alias("w")).join(by_type, F.col("w") == F.concat("event_type", F.lit("s"))).select("conv_id", "event_id", "ts")
    top = hits.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("k <= 15").select("conv_id", "event_id", "k")
    last = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts")
    ten = last.withColumns({"series": F.lit(1)}).withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("ts"), F.desc("event_id")))).select("event_id", "k")
    rest = q.join(top, "conv_id", "left_anti").select("conv_id").join(F.broadcast(ten), how="cross")  # ten rows
    return top.union(rest.select("conv_id", "event_id", "k"))


def f8_text_functions(spark, d):
    x = p.read(spark, d, "part")
    name = [c for c in x.columns if c.endswith("_name")][0]
    key = [c for c in x.columns if c.endswith("partkey")][0]
    t = F.trim(F.col(name))
    return x.select(F.col(key).alias("k"), F.upper(t).alias("up"), F.split_part(F.lower(t), F.lit("#"), F.lit(1)).alias("head"), F.substring(t, 1, 3).alias("three"), F.replace(t, F.lit("#"), F.lit("-")).alias("dashed"), t.startswith("P").alias("is_p"), F.concat_ws("/", F.lit("p"), F.substring(t, -3, 3)).alias("tail"))


def f9_regex_functions(spark, d):
    """Test, extract with groups, extract all, replace and full match over the events' properties and the documents' sources."""
    x = p.read(spark, d, "events")
    return x.select("event_id", F.regexp_extract("props", r'"(\w+)":\s*(\d+)', 1).alias("name"), F.regexp_extract("props", r'"(\w+)":\s*(\d+)', 2).cast("int").alias("number"), F.size(F.regexp_extract_all("props", F.lit(r"\d"), 0)).alias("digits"), F.regexp_replace("props", r"\d+", "N").alias("masked"), F.col("event_type").rlike("^(click|view)$").alias("passive"))


def f10_canonical_hash(spark, d):
    """The SHA-256 of a row as JSON with its keys in order."""
    x = p.read(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("hash"))
    return x


def f11_json_functions(spark, d):
    """A parsed field, a category with a default for unknown ones, and the row as JSON again."""
    k = F.from_json("props", "k int")["k"]
    kind = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).otherwise("other")
    return p.read(spark, d, "events").select("event_id", k.alias("k"), kind.alias("kind"), F.to_json(F.struct(kind.alias("kind"), k.alias("k"))).alias("json"))


def f12_array_functions(spark, d):
    """Distinct roles in order of turns, the first two, whether any text is long, and the long turns joined; a conversation is short."""
    x = p.read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("t"))
    roles = F.array_distinct(F.transform("t", lambda s: s["role"]))
    long = F.filter("t", lambda s: s["n"] > 400)
    return x.select("conv_id", F.array_join(roles, ",").alias("roles"), F.array_join(F.slice(F.transform("t", lambda s: s["n"].cast("string")), 1, 2), "-").alias("first_two"), F.exists("t", lambda s: s["n"] > 2000).alias("any_long"), F.array_join(F.transform(long, lambda s: s["turn"].cast("string")), ",").alias("long_turns"))


def f13_map_functions(spark, d):
    """Nations' regions from a dictionary with a default, and two columns zipped."""
    names = {0: "AFRICA", 1: "AMERICA", 2: "ASIA"}
    known = F.create_map(*(F.lit(e) for kv in names.items() for e in kv))
    x = p.read(spark, d, "nation")
    key = F.map_from_arrays(F.array(F.lit("key"), F.lit("region")), F.array(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")))
    return x.select("n_nationkey", F.coalesce(F.element_at(known, F.col("n_regionkey").cast("int")), F.lit("elsewhere")).alias("region"), F.element_at(key, F.lit("region")).alias("zipped"))


def f14_null_functions(spark, d):
    """Missing closes filled with the last known, with a constant, and masked where small."""
    x = p.dense_bars(spark, d)
    w = Window.partitionBy("code").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("date", "code", R6(F.last("close", ignorenulls=True).over(w)).alias("carried"), R6(F.coalesce("close", F.lit(0.0))).alias("zero"), R6(F.when(F.col("close") > 1000, F.col("close"))).alias("masked"), F.col("close").isNotNull().alias("known"))


def f2_abs_sign(spark, d):
    x = p.bars(spark, d)
    apart = F.col("close") - F.col("open")
    return x.select("date", "code", R6(F.abs(apart)).alias("size"), F.signum(apart).alias("side"))


def f5_numeric_functions(spark, d):
    x = p.bars(spark, d)
    r = F.col("close") / F.col("open")
    return x.select("date", "code", R6(F.log(r)).alias("log"), R6(F.log1p("volume")).alias("log1p"), R6(F.expm1(F.log(r))).alias("back"), R6(F.pow(r, F.lit(0.5))).alias("root"), R6(F.least(F.greatest(r, F.lit(0.9)), F.lit(1.1))).alias("clipped"), F.floor("volume").cast("long").alias("whole"))


def f6_logistic_and_knots(spark, d):
    """A logistic map of a score, and its linear interpolation between four knots."""
    s = F.percent_rank().over(Window.partitionBy("date").orderBy("value", "code"))
    x = p.bars(spark, d).select("date", "code", s.alias("s"))
    knots = ((0.0, 0.1), (0.25, 0.2), (0.75, 0.6), (1.0, 0.9))
    line = F.lit(knots[-1][1])
    for (a, ya), (b, yb) in reversed(list(zip(knots, knots[1:]))):
        line = F.when(F.col("s") <= b, ya + (yb - ya) * (F.col("s") - a) / (b - a)).otherwise(line)
    return x.select("date", "code", R6(1 / (1 + F.exp(-(-1.5 + 3 * F.col("s"))))).alias("logistic"), R6(line).alias("knots"))


def f7_date_functions(spark, d):
    """Year, month, weekday, days between, days added, dates parsed from digits, and the Friday that ends the week."""
    x = p.read(spark, d, "orders")
    day = F.to_date("o_orderdate")
    return x.select("o_orderkey", F.year(day).alias("year"), F.trunc(day, "MM").alias("month"), F.weekday(day).alias("weekday"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"), F.date_add(day, 31).alias("later"), F.to_date(F.date_format(day, "yyyyMMdd"), "yyyyMMdd").alias("parsed"), F.next_day(F.date_sub(day, 1), "FRI").alias("friday"))


def f15_cut(spark, d):
    """Intervals (a, b] with labels, the first closed on both sides."""
    v = F.col("o_totalprice")
    label = F.when(v <= 50000, "[0, 50k]").when(v <= 150000, "(50k, 150k]").when(v <= 300000, "(150k, 300k]").otherwise("above")
    return p.read(spark, d, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("most"))


def p20_search(spark, d):
    """Customers whose name or segment holds a text, by segment in order of balance, with the count of each group."""
    x = p.read(spark, d, "customer").where(F.contains(F.lower("c_name"), F.lit("7")) | F.contains(F.lower("c_mktsegment"), F.lit("machin")))
    w = Window.partitionBy("c_mktsegment")
    return x.select("c_custkey", "c_mktsegment", F.row_number().over(w.orderBy(F.coalesce("c_acctbal", F.lit(-9.0)).desc(), "c_custkey")).alias("place"), F.count("*").over(w).alias("group_n"), F.count_if(F.col("c_acctbal") > 5000).over(w).alias("group_rich"))


CALLS = (
    x3_rule_screen, x4_report_routing, x1_reply_json, x2_library_ingest, d6_reply_rows, u2_distinct_by_key, x6_window_variants, x5_explain, x7_retrieval, f8_text_functions, f9_regex_functions, f10_canonical_hash,
    f11_json_functions, f12_array_functions, f13_map_functions, f14_null_functions, f2_abs_sign, f5_numeric_functions, f6_logistic_and_knots, f7_date_functions, f15_cut, p20_search,
)
QUERIES = {c.__name__: c for c in CALLS}




def _met(rule: str, pattern: str) -> str:
    return f"CASE WHEN regexp_extract(low, '{pattern}', 0) != '' THEN '{rule}: ' || regexp_extract(low, '{pattern}', 0) END"


SCREEN = f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_matches(coalesce(source, ''), '^[a-m]') AS learners FROM documents),
nm AS (SELECT DISTINCT substring(lower(r_name), 1, 2) AS name FROM region),
wd AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(low, '[a-z]+')) AS name FROM x WHERE learners),
nd AS (SELECT doc_id, string_agg(name, ' ' ORDER BY name) AS names FROM wd JOIN nm USING (name) GROUP BY 1),
sc AS (SELECT doc_id, list_filter([{', '.join(_met(r, q) for r, q in RULES)}, CASE WHEN learners AND doc_id % 90 < {YOUNG_DAYS} THEN 'data-age: ' || doc_id % 90 END, 'current-pick: ' || names, CASE WHEN NOT learners AND NOT contains(low, '{DISCLAIMER}') THEN 'disclaimer: missing' END], lambda v: v IS NOT NULL) AS problems FROM x LEFT JOIN nd USING (doc_id))"""


def _item(k: int) -> str:
    return f"""'{{"name": "' || nm || ' {k}", "category": "' || CASE WHEN (conv_id + {k}) % 5 = 0 THEN 'unheard' ELSE ['momentum', 'reversal', 'volume', 'volatility'][(conv_id + {k}) % 4 + 1] END || '", "expression": "Mean(close, ' || (conv_id * 7 + {k} * 13) % 70 || ')", "hypothesis": "h{k}"}}'"""


#: The oracle knows what each reply was made of, so it need not parse: a cut-off reply has lost its last item.
LIB = f"""WITH cv AS (SELECT conv_id, turn, regexp_replace(substring(coalesce(text, ''), 1, 40), '["\\\\\\n]', ' ', 'g') AS nm FROM conversations WHERE role = 'assistant'),
it AS (SELECT conv_id, turn, nm, unnest(CASE WHEN conv_id % 4 = 3 THEN [1, 2] ELSE [1, 2, 3] END) AS k FROM cv),
ex AS (SELECT conv_id, turn, k - 1 AS pos, substring(nm || ' ' || k, 1, 60) AS name, CASE WHEN (conv_id + k) % 5 = 0 THEN 'other' ELSE ['momentum', 'reversal', 'volume', 'volatility'][(conv_id + k) % 4 + 1] END AS category, CAST((conv_id * 7 + k * 13) % 70 AS INTEGER) AS w FROM it),
lib AS (SELECT *, 'Mean(close, ' || w || ')' AS expression, CASE WHEN w NOT BETWEEN 2 AND 60 THEN 'invalid' WHEN row_number() OVER (PARTITION BY w ORDER BY conv_id, turn, pos) = 1 THEN 'valid' ELSE 'duplicate' END AS status FROM ex)"""
SQL = {
    "x3_rule_screen": f"{SCREEN} SELECT doc_id, array_to_string(problems, '; ') AS problems, CAST(len(problems) AS INTEGER) AS n FROM sc",
    "x4_report_routing": f"{SCREEN} SELECT CASE WHEN len(problems) = 0 THEN 'clean' ELSE 'blocked' END AS route, coalesce(split_part(problems[1], ':', 1), 'none') AS rule, count(*) AS n, min(doc_id) AS first_doc FROM sc GROUP BY 1, 2",
    "x1_reply_json": f"{LIB} SELECT conv_id, turn, CAST(CASE WHEN conv_id % 4 = 3 THEN 2 ELSE 3 END AS INTEGER) AS n, conv_id % 4 = 3 AS truncated, 'Mean(close, ' || (conv_id * 7 + 13) % 70 || ')' AS \"first\" FROM cv",
    "x2_library_ingest": f"{LIB} SELECT printf('F%04d', 12 + row_number() OVER (ORDER BY conv_id, turn, pos)) AS id, name, category, expression, w AS \"window\" FROM lib WHERE status = 'valid'",
    "d6_reply_rows": f"{LIB} SELECT category, status, count(*) AS n FROM lib GROUP BY 1, 2",
    "u2_distinct_by_key": f"{LIB} SELECT expression, arg_min(conv_id, (conv_id, turn, pos)) AS first_conv, arg_max(conv_id, (conv_id, turn, pos)) AS last_conv FROM lib GROUP BY 1",
    "x6_window_variants": f"{LIB}, v AS (SELECT expression, w, s, CAST(greatest(2, least(60, round_even(w * s, 0))) AS INTEGER) AS z FROM lib, (SELECT unnest([0.5::DOUBLE, 1.5, 2.0]) AS s) WHERE status = 'valid') SELECT expression, {r6('min(s)')} AS scale, 'Mean(close, ' || z || ')' AS variant FROM v WHERE z != w GROUP BY expression, z",
    "x5_explain": f"""{WITH}, x AS (SELECT date, code, CAST(code % 4 AS INTEGER) AS k, code % 5 * 5 + 5 AS w, percent_rank() OVER (PARTITION BY date ORDER BY value, code) AS q FROM bars), m AS (SELECT *, replace([{', '.join(repr(v) for v in FAMILIES.values())}][k + 1], '{{w}}', w::VARCHAR) AS t FROM x)
 SELECT date, code, upper(t[1]) || ' ' || t[2:] || ' is ' || CASE WHEN q >= 0.9 THEN 'among the highest' WHEN q <= 0.1 THEN 'among the lowest' ELSE 'in the middle' END AS sentence FROM m""",
    "x7_retrieval": """WITH q AS (SELECT conv_id, list_concat(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: length(w) > 3), CASE conv_id % 3 WHEN 0 THEN ['errors'] WHEN 1 THEN ['clicks', 'purchases'] ELSE [] END) AS words FROM conversations WHERE turn = 0),
 h AS (SELECT conv_id, event_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS k FROM q JOIN events ON list_contains(words, event_type || 's') QUALIFY k <= 15),
 l AS (SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS k FROM events QUALIFY k <= 10) SELECT * FROM h UNION ALL SELECT conv_id, event_id, k FROM q, l WHERE conv_id NOT IN (SELECT conv_id FROM h)""",
    "f8_text_functions": "SELECT p_partkey AS k, upper(trim(p_name)) AS up, split_part(lower(trim(p_name)), '#', 1) AS head, substring(trim(p_name), 1, 3) AS three, replace(trim(p_name), '#', '-') AS dashed, starts_with(trim(p_name), 'P') AS is_p, 'p/' || right(trim(p_name), 3) AS tail FROM part",
    "f9_regex_functions": """SELECT event_id, regexp_extract(props, '"(\\w+)":\\s*(\\d+)', 1) AS name, CAST(regexp_extract(props, '"(\\w+)":\\s*(\\d+)', 2) AS INTEGER) AS number, CAST(len(regexp_extract_all(props, '\\d')) AS INTEGER) AS digits, regexp_replace(props, '\\d+', 'N', 'g') AS masked, regexp_full_match(event_type, 'click|view') AS passive FROM events""",
    "f10_canonical_hash": """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS hash FROM events""",
    "f11_json_functions": """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other' END AS kind, '{"kind":"' || CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other' END || '","k":' || json_extract(props, '$.k') || '}' AS json FROM events""",
    "f12_array_functions": """WITH o AS (SELECT conv_id, list({'r': role, 'n': length(coalesce(text, '')), 't': turn} ORDER BY turn, role) AS t, string_agg(CASE WHEN k = 1 THEN role END, ',' ORDER BY turn, role) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) GROUP BY 1)
 SELECT conv_id, roles, array_to_string(list_transform(t[1:2], lambda s: s.n::VARCHAR), '-') AS first_two, len(list_filter(t, lambda s: s.n > 2000)) > 0 AS any_long, array_to_string(list_transform(list_filter(t, lambda s: s.n > 400), lambda s: s.t::VARCHAR), ',') AS long_turns FROM o""",
    "f13_map_functions": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' ELSE 'elsewhere' END AS region, CAST(n_regionkey AS VARCHAR) AS zipped FROM nation",
    "f14_null_functions": f"{WITH} SELECT date, code, {r6('last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS carried, {r6('coalesce(close, 0)')} AS zero, {r6('CASE WHEN close > 1000 THEN close END')} AS masked, close IS NOT NULL AS known FROM dense",
    "f2_abs_sign": f"{WITH} SELECT date, code, {r6('abs(close - open)')} AS size, CAST(sign(close - open) AS DOUBLE) AS side FROM bars",
    "f5_numeric_functions": f"{WITH} SELECT date, code, {r6('ln(close / open)')} AS log, {r6('ln(1 + volume)')} AS log1p, {r6('close / open - 1')} AS back, {r6('pow(close / open, 0.5)')} AS root, {r6('least(greatest(close / open, 0.9::DOUBLE), 1.1::DOUBLE)')} AS clipped, CAST(floor(volume) AS BIGINT) AS whole FROM bars",
    "f6_logistic_and_knots": f"{WITH}, x AS (SELECT date, code, percent_rank() OVER (PARTITION BY date ORDER BY value, code) AS s FROM bars) SELECT date, code, {r6('1 / (1 + exp(1.5 - 3 * s))')} AS logistic, {r6('CASE WHEN s <= 0.25 THEN 0.1 + 0.4 * s WHEN s <= 0.75 THEN 0.2 + 0.8 * (s - 0.25) ELSE 0.6 + 1.2 * (s - 0.75) END')} AS knots FROM x",
    "f7_date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(CAST(o_orderdate AS DATE) + 31 AS DATE) AS later, CAST(o_orderdate AS DATE) AS parsed, CAST(CAST(o_orderdate AS DATE) + CAST((5 - isodow(CAST(o_orderdate AS DATE)) + 7) % 7 AS INTEGER) AS DATE) AS friday FROM orders",
    "f15_cut": "SELECT CASE WHEN o_totalprice <= 50000 THEN '[0, 50k]' WHEN o_totalprice <= 150000 THEN '(50k, 150k]' WHEN o_totalprice <= 300000 THEN '(150k, 300k]' ELSE 'above' END AS label, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1",
    "p20_search": "SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(c_acctbal, -9) DESC, c_custkey) AS INTEGER) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS group_n, count(CASE WHEN c_acctbal > 5000 THEN 1 END) OVER (PARTITION BY c_mktsegment) AS group_rich FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'machin')",
}
