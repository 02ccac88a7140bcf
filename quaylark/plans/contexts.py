"""Flags, filters, contexts, feature tables, summaries and reports on news, prices and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.functions import text as X
from quaylark.operators import series as S
from quaylark.plans.registry import query
from quaylark.plans.series import _DENSE, _SESSIONS, W, _returns, sessions
from quaylark.plans.tables import DAILY, PANEL, RETURNS, cents, daily, news_calendar, panel, ratio, rounded, table


@query(f"WITH {PANEL}, f AS (SELECT ticker, min(trading_index) FILTER (close IS NOT NULL) AS a FROM panel GROUP BY 1) SELECT date, panel.ticker, trading_index - a < 20 AS warm FROM panel JOIN f ON f.ticker = panel.ticker WHERE trading_index >= a")
def warm_up_flags(spark, d):
    """The first twenty sessions of each ticker."""
    first = F.min(F.when(F.col("close").isNotNull(), F.col("trading_index"))).over(Window.partitionBy("ticker"))
    return panel(spark, d).withColumn("a", first).where("trading_index >= a").select("date", "ticker", (F.col("trading_index") - F.col("a") < 20).alias("warm"))


def switched(rows, recent: bool = False, errors: bool = False, by_type: bool = False):
    """A summary whose plan holds only the parts that are asked for."""
    if recent:
        rows = rows.where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    if errors:
        rows = rows.where("event_type = 'error'")
    return rows.groupBy((F.col("event_type") if by_type else F.lit("all")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 'plain' AS run, 'all' AS kind, count(*) AS n FROM events UNION ALL SELECT 'recent', event_type, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY event_type UNION ALL SELECT 'errors', 'all', count(*) FROM events WHERE event_type = 'error'")
def plan_switches(spark, d):
    e = table(spark, d, "events")
    runs = {"plain": {}, "recent": {"recent": True, "by_type": True}, "errors": {"errors": True}}
    out = None
    for name, flags in runs.items():
        part = switched(e, **flags).withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(r"""WITH d AS (SELECT documents.doc_id, toxic AS y, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '')) AS w FROM documents JOIN labels ON labels.doc_id = documents.doc_id), n AS (SELECT count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM d),
t AS (SELECT term, count(*) FILTER (y = 1) AS ta, count(*) FILTER (y = 0) AS tb FROM (SELECT y, unnest(w) AS term FROM d) GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT term, ln((ta + 1) / (a + 2e0)) - ln((tb + 1) / (b + 2e0)) AS c FROM t, n),
k AS (SELECT 1 AS class, term, c, row_number() OVER (ORDER BY round(c, 9) DESC, term) AS k FROM c UNION ALL SELECT 0, term, -c, row_number() OVER (ORDER BY round(-c, 9) DESC, term) FROM c) SELECT class, term, round(c, 7) AS coefficient, CAST(k AS INTEGER) AS k FROM k WHERE k <= 10""")
def top_terms_by_class(spark, d):
    """Ten terms of each class by their coefficient (smoothed log-odds of documents that have them)."""
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("toxic").alias("y"), words.alias("w"))
    n = docs.agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    t = docs.select("y", F.explode("w").alias("term")).groupBy("term").agg(F.count_if(F.col("y") == 1).alias("ta"), F.count_if(F.col("y") == 0).alias("tb"), F.count("*").alias("n")).where("n >= 5").drop("n")
    c = t.join(F.broadcast(n)).select("term", (F.ln((F.col("ta") + 1) / (F.col("a") + 2.0)) - F.ln((F.col("tb") + 1) / (F.col("b") + 2.0))).alias("c"))
    out = None
    for label, sign in ((1, 1), (0, -1)):
        best = c.select("term", (sign * F.col("c")).alias("c")).orderBy(F.desc(F.round("c", 9)), "term").limit(10)
        part = best.select(F.lit(label).alias("class"), "term", F.round("c", 7).alias("coefficient"), F.row_number().over(Window.orderBy(F.desc(F.round("c", 9)), "term")).alias("k"))  # ten rows
        out = part if out is None else out.unionByName(part)
    return out


_HAS = lambda words: "(" + " OR ".join(f"contains(s, '{w}')" for w in words) + ")"
_LEGAL = {"subject": ["the ", "le ", "el "], "legal": ["license", "copyright"], "authority": ["from ", "pour "], "strong": ["token", "that "], "council": ["with ", "dans "]}


@query(f"""WITH w AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 1250)) AS i, lower(text) AS t FROM documents), s AS (SELECT doc_id, substr(t, i + 1, 2500) AS s FROM w)
SELECT doc_id, bool_or({_HAS(_LEGAL['subject'])} AND ({_HAS(_LEGAL['legal'])} OR ({_HAS(_LEGAL['authority'])} AND ({_HAS(_LEGAL['strong'])} OR {_HAS(_LEGAL['council'])})))) AS kept FROM s GROUP BY doc_id""")
def legal_filter(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.legal_filter(F.col("text"), **_LEGAL).alias("kept"))


@query("""WITH w AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 500)) AS i, lower(text) AS t FROM documents), s AS (SELECT doc_id, t, substr(t, i + 1, 1000) AS s FROM w),
c AS (SELECT doc_id, t, CAST(contains(s, 'that ') AS INTEGER) + CAST(contains(s, 'with ') AS INTEGER) + CAST(contains(s, 'from ') AS INTEGER) + CAST(contains(s, 'this ') AS INTEGER) AS n, contains(s, 'was ') OR contains(s, 'the ') AS m FROM s)
SELECT doc_id, bool_or(n >= 3 AND m) AND (contains(left(min(t), 300), 'was ') OR contains(left(min(t), 300), 'the ')) AS kept FROM c GROUP BY doc_id""")
def window_filter_lead(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.window_filter(F.col("text"), ["that ", "with ", "from ", "this "], ["was ", "the "], lead=300).alias("kept"))


@query(r"""WITH p AS (SELECT p_partkey, upper(left(p_type, 3)) || ' ' || upper(p_name) || ' X1' || CAST(p_size % 10 AS VARCHAR) AS said FROM part), f AS (SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(said, '\b[A-Z0-9]{3}\b'))) AS c FROM p)
SELECT p_partkey, array_to_string(list_filter(c, lambda x: x IN ('ECO', 'STA', 'X11', 'X12')), ',') AS known, array_to_string(list_filter(c, lambda x: x NOT IN ('ECO', 'STA', 'X11', 'X12')), ',') AS rejected FROM f""")
def ticker_validation(spark, d):
    """Codes of three signs in a text: those of the list, and the rejected rest."""
    said = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit(" "), F.upper("p_name"), F.lit(" X1"), (F.col("p_size") % 10).cast("string"))
    known, rejected = X.codes(said, ["ECO", "STA", "X11", "X12"])
    return table(spark, d, "part").select("p_partkey", F.array_join(known, ",").alias("known"), F.array_join(rejected, ",").alias("rejected"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9 AS hours FROM events")
def story_age_hours(spark, d):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", X.hours_between(F.col("ts"), before).alias("hours"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 17:00:00' AND ts < TIMESTAMP '2024-01-11 17:00:00'")
def zoned_range_filter(spark, d):
    """Two days of a clock seven hours ahead."""
    return table(spark, d, "events").where(X.within(F.col("ts"), "2024-01-10 00:00:00", "2024-01-12 00:00:00", "Asia/Ho_Chi_Minh")).select("event_id")


@query(f"WITH {PANEL} SELECT date, ticker, close * volume * 1000 / 1e9 AS value_bn, close * 1000 * 50 / 1e9 AS cap_bn FROM panel WHERE close IS NOT NULL")
def traded_value(spark, d):
    return panel(spark, d).where("close IS NOT NULL").select("date", "ticker", (F.col("close") * F.col("volume") * 1000 / 1e9).alias("value_bn"), (F.col("close") * 1000 * 50 / 1e9).alias("cap_bn"))


@query(f"""WITH {RETURNS}, m AS (SELECT date, trading_index, ticker, r, close * volume AS v FROM ret), q AS (SELECT *, coalesce(lag(v) OVER ({W}), 0) >= 20000 AS liquid FROM m)
SELECT date, count(r) AS n, round(CASE WHEN count(r) >= 10 THEN avg(r) END, 6) AS r FROM q WHERE liquid GROUP BY date""")
def benchmark_liquid(spark, d):
    """Equal weight of the tickers that were liquid the day before, of ten at the least."""
    rows = _returns(spark, d).withColumn("v", F.col("close") * F.col("volume"))
    rows = rows.withColumn("liquid", F.coalesce(F.lag("v").over(S.by()), F.lit(0.0)) >= 20000).where("liquid")
    return rows.groupBy("date").agg(F.count("r").alias("n"), F.round(F.when(F.count("r") >= 10, F.avg("r")), 6).alias("r"))


@query(f"""WITH {DAILY}, x AS (SELECT date, ln(1 + volume) AS lv, trading_index FROM daily),
f AS (SELECT date, avg(lv) OVER a AS later, count(lv) OVER a AS na, avg(lv) OVER b AS mean, stddev_samp(lv) OVER b AS sd, count(lv) OVER b AS nb FROM x WINDOW a AS (ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), b AS (ORDER BY trading_index ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT date, round((later - mean) / sd, 6) AS z, CASE WHEN (later - mean) / sd > 0.5 THEN 1 WHEN (later - mean) / sd < -0.5 THEN -1 ELSE 0 END AS y FROM f WHERE na = 5 AND nb >= 40 AND sd > 0""")
def attention_z(spark, d):
    """Log volume of the next five sessions against the last sixty, in their deviations, and its class."""
    rows = daily(spark, d).withColumn("lv", F.log1p("volume"))
    rows = rows.withColumns({"later": S.ahead("lv", 1, 5, None) / 5, "mean": S.rolled(F.avg, "lv", 60, 40, member=None), "sd": S.rolled(F.stddev_samp, "lv", 60, 40, member=None)})
    z = (F.col("later") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return rows.withColumn("z", z).where("z IS NOT NULL").select("date", F.round("z", 6).alias("z"), F.when(F.col("z") > 0.5, 1).when(F.col("z") < -0.5, -1).otherwise(0).alias("y"))


@query(f"""WITH {_DENSE}, t AS (SELECT date, sum(n) AS heat, count(*) FILTER (n > 0) AS named, sum(tone) AS tone FROM dense GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM t)
SELECT dense.date, ticker, n, CAST(heat AS BIGINT) AS heat, named, round(n * 1e0 / greatest(heat, 1), 8) AS share, round(dense.tone - (z.tone - dense.tone) / greatest(heat - n, 1), 5) AS tone_gap FROM dense JOIN z ON z.date = dense.date WHERE n > 0""")
def news_heat_context(spark, d):
    """A ticker's news beside that of all others in its session."""
    # scores are whole hundredths: their sums, and the gap up to its last rounding, are whole numbers that no order of rows changes
    known = sessions(spark, d).where("session IS NOT NULL AND ticker IS NOT NULL")
    rows = known.groupBy(F.col("session").alias("date"), "ticker").agg(F.count("*").alias("n"), F.coalesce(F.sum(cents("score")), F.lit(0)).alias("tone"))
    t = rows.groupBy("date").agg(F.sum("n").alias("heat"), F.count("*").alias("named"), F.sum("tone").alias("all_tone"))
    out = rows.join(F.broadcast(t), "date")  # a row a session
    others = F.greatest(F.col("heat") - F.col("n"), F.lit(1))
    gap = ratio(F.col("tone") * others - (F.col("all_tone") - F.col("tone")), 100 * others, 5)
    return out.select("date", "ticker", "n", "heat", "named", rounded(F.col("n") / F.col("heat"), 8).alias("share"), gap.alias("tone_gap"))


@query(f"""WITH {_SESSIONS}, l AS (SELECT date FROM ncal ORDER BY trading_index DESC LIMIT 5), s5 AS (SELECT s.* FROM s JOIN l ON l.date = s.session), ty AS (SELECT event_type, count(*) AS c FROM s5 GROUP BY 1)
SELECT (SELECT max(date) FROM ncal) AS session, count(*) AS news, count(DISTINCT ticker) AS tickers, round(avg(CASE WHEN score < 0 THEN 1e0 ELSE 0e0 END), 8) AS bad_share, (SELECT event_type FROM ty ORDER BY c DESC, event_type LIMIT 1) AS top_type, round(sum(score), 2) AS tone FROM s5""")
def sector_kpis(spark, d):
    """The figures at the top of a dashboard: the last five sessions."""
    last = news_calendar(spark, d).orderBy(F.desc("trading_index")).limit(5).select(F.col("date").alias("session"))
    s5 = sessions(spark, d).join(F.broadcast(last), "session")
    top = s5.groupBy("event_type").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "event_type").limit(1).select(F.col("event_type").alias("top_type"))
    k = s5.agg(F.count("*").alias("news"), F.count_distinct("ticker").alias("tickers"), F.round(F.avg((F.col("score") < 0).cast("double")), 8).alias("bad_share"), F.round(F.sum("score"), 2).alias("tone"))
    return last.agg(F.max("session").alias("session")).join(F.broadcast(k)).join(F.broadcast(top))


@query("""WITH a AS (SELECT o_orderpriority AS name, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS k FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // 100 AS BIGINT) AS spent FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT a.name, CAST(k AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS hits, CAST((k * 1000 + n // 2) // n // 10 AS VARCHAR) || ',' || CAST((k * 1000 + n // 2) // n % 10 AS VARCHAR) || ' %' AS share, CASE WHEN spent IS NULL THEN '-' ELSE '+' || CAST(spent AS VARCHAR) END AS spent FROM a LEFT JOIN b ON b.name = a.name""")
def results_table(spark, d):
    """One formatted table of several results: k/n, per cent with a decimal comma, signed sums."""
    from quaylark.plans.tables import cents

    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    b = o.where(F.col("o_orderdate") >= F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")).groupBy(F.col("o_orderpriority").alias("name")).agg(F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div 100").alias("spent"))
    tenths = F.expr("(k * 1000 + n div 2) div n")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" %"))
    return a.join(b, "name", "left").select("name", F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")).alias("hits"), shown.alias("share"), F.coalesce(F.concat(F.lit("+"), F.col("spent").cast("string")), F.lit("-")).alias("spent"))


@query("""WITH i AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'long' END AS label FROM documents), c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label FROM labels)
SELECT d.doc_id, coalesce(i.label, c.label, 'none') AS label, CASE WHEN i.label IS NOT NULL THEN 'text' WHEN c.label IS NOT NULL THEN 'mark' ELSE 'none' END AS origin, regexp_matches(d.text, '[0-9]') AS has_number, d.text IS NOT NULL AND contains(d.text, '?') AS asks FROM documents d LEFT JOIN i ON i.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""")
def article_labels(spark, d):
    """The label of an article: its own rule's, else its mark's; and what its text is like."""
    docs = table(spark, d, "documents")
    marks = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("mark"))
    own = F.when(F.col("n_chars") > 1500, "long")
    rows = docs.join(marks, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(own, "mark", F.lit("none")).alias("label"), F.when(own.isNotNull(), "text").when(F.col("mark").isNotNull(), "mark").otherwise("none").alias("origin"), F.col("text").rlike("[0-9]").alias("has_number"), (F.col("text").isNotNull() & F.coalesce(F.contains("text", F.lit("?")), F.lit(False))).alias("asks"))


@query(f"""WITH {_SESSIONS}, f AS (SELECT ticker, session, avg(CASE WHEN event_type IN ('purchase', 'signup') THEN 1e0 ELSE 0e0 END) AS firm, sum(score) AS tone, count(*) AS n FROM s WHERE session IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, sum(tone) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT ticker, session, round(firm, 8) AS firm, firm > 0.5 AND coalesce(sign(round(tone, 4)) * before, 0) <= 0 AS follow FROM x""")
def hand_rule(spark, d):
    """Follow where most news is the firm's own and what came before hasn't gone its way yet."""
    f = sessions(spark, d).where("session IS NOT NULL").groupBy("ticker", "session").agg(F.avg(F.col("event_type").isin("purchase", "signup").cast("double")).alias("firm"), F.sum("score").alias("tone"))
    before = F.sum("tone").over(Window.partitionBy("ticker").orderBy("session").rowsBetween(-3, -1))
    return f.select("ticker", "session", F.round("firm", 8).alias("firm"), ((F.col("firm") > 0.5) & (F.coalesce(F.signum(F.round("tone", 4)) * before, F.lit(0.0)) <= 0)).alias("follow"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) FILTER (value > 50) AS good, count(*) FILTER (value < 50) AS bad, count(*) FILTER (value = 50) AS even, count(DISTINCT user_id) AS covered FROM events GROUP BY 1, 2")
def polarity_by_group(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count_if(v > 50).alias("good"), F.count_if(v < 50).alias("bad"), F.count_if(v == 50).alias("even"), F.count_distinct("user_id").alias("covered"))


@query(f"WITH {PANEL}, f AS (SELECT ticker, arg_min(close, trading_index) FILTER (close IS NOT NULL) AS base, count(close) AS known, count(*) AS all_ FROM panel GROUP BY 1) SELECT date, panel.ticker, round(100 * close / base, 6) AS rebased, round(known * 1e0 / all_, 8) AS coverage FROM panel JOIN f ON f.ticker = panel.ticker WHERE close IS NOT NULL")
def rebased_prices(spark, d):
    w = Window.partitionBy("ticker")
    p = panel(spark, d).withColumns({"base": F.min_by("close", F.when(F.col("close").isNotNull(), F.col("trading_index"))).over(w), "known": F.count("close").over(w), "all_": F.count("*").over(w)})
    return p.where("close IS NOT NULL").select("date", "ticker", F.round(100 * F.col("close") / F.col("base"), 6).alias("rebased"), F.round(F.col("known") / F.col("all_"), 8).alias("coverage"))


@query(f"WITH {PANEL} SELECT year(date) AS year, CAST(quarter(date) AS INTEGER) AS quarter, count(*) FILTER (close IS NULL) AS silent, count(*) FILTER (close * volume < 20000) AS illiquid, count(DISTINCT ticker) FILTER (close IS NOT NULL) AS covered FROM panel GROUP BY 1, 2")
def quarterly_illiquid(spark, d):
    c = F.col("close")
    return panel(spark, d).groupBy(F.year("date").cast("long").alias("year"), F.quarter("date").alias("quarter")).agg(F.count_if(c.isNull()).alias("silent"), F.count_if(c * F.col("volume") < 20000).alias("illiquid"), F.count_distinct(F.when(c.isNotNull(), F.col("ticker"))).alias("covered"))


_GROUPS = {"market": ["click"], "legal": ["error"], "firm": ["purchase", "signup"], "other": ["view"]}


@query(f"""WITH {_SESSIONS}, f AS (SELECT session AS date, count(*) AS n, sum(score) AS tone, {', '.join(f"count(*) FILTER (event_type IN ({', '.join(chr(39) + t + chr(39) for t in ts)})) AS n_{g}, coalesce(sum(score) FILTER (event_type IN ({', '.join(chr(39) + t + chr(39) for t in ts)})), 0) AS tone_{g}" for g, ts in _GROUPS.items())}, count(DISTINCT ticker) AS breadth FROM s WHERE session IS NOT NULL GROUP BY 1),
c AS (SELECT ncal.date, trading_index, {', '.join(f"coalesce({x}_{g}, 0) AS {x}_{g}" for g in _GROUPS for x in ("n", "tone"))}, coalesce(n, 0) AS n, coalesce(tone, 0) AS tone, coalesce(breadth, 0) AS breadth FROM ncal LEFT JOIN f ON f.date = ncal.date)
SELECT date, n, breadth, {', '.join(f"n_{g}, round(tone_{g} / greatest(n_{g}, 1), 6) AS tone_{g}, round(n_{g} * 1e0 / greatest(n, 1), 8) AS share_{g}" for g in _GROUPS)}, CAST(sum(n) OVER w5 AS BIGINT) AS n5, round(sum(tone) OVER w5, 4) AS tone5, CAST(lag(n) OVER (ORDER BY trading_index) AS BIGINT) AS n_before, n_legal >= 5 AS policy_day
FROM c WINDOW w5 AS (ORDER BY trading_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def industry_groups(spark, d):
    """News of the industry by session: counts, tone and share of each group, breadth, sums of five sessions, policy days."""
    rows = sessions(spark, d).where("session IS NOT NULL")
    made = {}
    for g, types in _GROUPS.items():
        is_g = F.col("event_type").isin(*types)
        made |= {f"n_{g}": F.count_if(is_g), f"tone_{g}": F.coalesce(F.sum(F.when(is_g, F.col("score"))), F.lit(0.0))}
    f = rows.groupBy(F.col("session").alias("date")).agg(F.count("*").alias("n"), F.sum("score").alias("tone"), F.count_distinct("ticker").alias("breadth"), *(c.alias(k) for k, c in made.items()))
    c = news_calendar(spark, d).join(f, "date", "left").fillna(0)
    w, one = S.frame(5, member=None), F.lit(1)
    cut = [x for g in _GROUPS for x in (F.col(f"n_{g}"), F.round(F.col(f"tone_{g}") / F.greatest(f"n_{g}", one), 6).alias(f"tone_{g}"), F.round(F.col(f"n_{g}") / F.greatest("n", one), 8).alias(f"share_{g}"))]
    return c.select("date", "n", "breadth", *cut, F.sum("n").over(w).alias("n5"), F.round(F.sum("tone").over(w), 4).alias("tone5"), F.lag("n").over(S.by(None)).alias("n_before"), (F.col("n_legal") >= 5).alias("policy_day"))


_HORIZONS = (1, 5, 20, 60)


@query(f"""WITH {RETURNS}, b AS (SELECT date, avg(r) AS rb FROM ret GROUP BY date), x AS (SELECT ret.*, rb, close * volume AS v FROM ret JOIN b ON b.date = ret.date)
SELECT date, ticker, {', '.join(f"round(CASE WHEN count(r) OVER w{h} >= {max(1, h // 2)} THEN sum(r) OVER w{h} END, 6) AS r{h}" for h in _HORIZONS)}, {', '.join(f"round(CASE WHEN count(r) OVER w{h} >= {h // 2} THEN stddev_samp(r) OVER w{h} END, 6) AS vol{h}" for h in _HORIZONS[1:])},
{', '.join(f"round(CASE WHEN count(r) OVER w{h} >= {h // 2} THEN sum(r - rb) OVER w{h} END, 6) AS ar{h}" for h in _HORIZONS[1:])}, round(CASE WHEN count(v) OVER w20 >= 10 THEN ln(avg(v) OVER w20) END, 6) AS size20, round(ln(close) - ln(max(close) OVER w60), 6) AS from_high, round(ln(close) - ln(min(close) OVER w60), 6) AS from_low,
round(CASE WHEN count(r) OVER w20 >= 10 THEN max(r) OVER w20 END, 6) AS best20, round(CASE WHEN count(r) OVER w20 >= 10 THEN min(r) OVER w20 END, 6) AS worst20
FROM x WINDOW {', '.join(f"w{h} AS ({W} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)" for h in _HORIZONS)}""")
def price_feature_table(spark, d):
    """Returns, deviations and abnormal returns over four horizons, size, distance from extremes, best and worst days."""
    rows = _returns(spark, d)
    b = rows.groupBy("date").agg(F.avg("r").alias("rb"))
    x = rows.join(F.broadcast(b), "date").withColumns({"v": F.col("close") * F.col("volume"), "ar": F.col("r") - F.col("rb")})
    cut = [F.round(S.rolled(F.sum, "r", h, max(1, h // 2)), 6).alias(f"r{h}") for h in _HORIZONS]
    cut += [F.round(S.rolled(F.stddev_samp, "r", h, h // 2), 6).alias(f"vol{h}") for h in _HORIZONS[1:]] + [F.round(S.rolled(F.sum, "ar", h, h // 2), 6).alias(f"ar{h}") for h in _HORIZONS[1:]]
    w = S.frame(60)
    cut += [F.round(F.ln(S.rolled(F.avg, "v", 20, 10)), 6).alias("size20"), F.round(F.ln("close") - F.ln(F.max("close").over(w)), 6).alias("from_high"), F.round(F.ln("close") - F.ln(F.min("close").over(w)), 6).alias("from_low")]
    cut += [F.round(S.rolled(F.max, "r", 20, 10), 6).alias("best20"), F.round(S.rolled(F.min, "r", 20, 10), 6).alias("worst20")]
    return x.select("date", "ticker", *cut)


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, ts, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), u AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY value DESC, event_id) AS n FROM e), b AS (SELECT * FROM u WHERE n = 1)
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS articles, string_agg(event_type, ',' ORDER BY event_type) AS types, max(value) AS top_value, CAST(sum(CASE WHEN k > 50 THEN 1 ELSE 0 END) AS BIGINT) AS positive, min(event_id) AS first_id FROM b GROUP BY 1, 2""")
def news_build(spark, d):
    """Items to facts: the strongest version of each article, labels from JSON, one row a ticker and day."""
    e = table(spark, d, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "day": F.col("ts").cast("date")})
    best = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "day", "event_type").orderBy(F.desc("value"), "event_id"))).where("n = 1")
    return best.groupBy("user_id", "day").agg(F.count("*").alias("articles"), F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types"), F.max("value").alias("top_value"), F.count_if(F.col("k") > 50).alias("positive"), F.min("event_id").alias("first_id"))


@query("SELECT c_custkey, sha256('{\"a\":' || CAST(c_nationkey AS VARCHAR) || ',\"b\":\"' || c_mktsegment || '\",\"m\":{\"k\":\"1\",\"z\":\"' || c_mktsegment || '\"}}') AS digest FROM customer")
def canonical_digest(spark, d):
    """Digest of a JSON object with its keys, and those of a map in it, in order."""
    m = X.sorted_map(F.create_map(F.lit("z"), F.col("c_mktsegment"), F.lit("k"), F.lit("1")))
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("b"), F.col("c_nationkey").alias("a"), m.alias("m")).select("c_custkey", X.digest(["m", "b", "a"]).alias("digest"))
