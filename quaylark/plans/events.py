"""Queries on events: facts, outcomes, credibility, paths, stories, portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.operators import events as E
from quaylark.operators import series as S
from quaylark.plans.registry import query
from quaylark.plans.series import _SESSIONS, abnormal, sessions
from quaylark.plans.tables import DAILY, PANEL, RETURNS, daily, news_calendar, panel, table

_EVENTS = _SESSIONS + """, ev AS (SELECT ticker, session, count(*) AS n, round(sum(score), 4) AS score, CAST(sign(round_even(sum(score), 6)) AS INTEGER) AS direction,
  arg_max(event_type, abs(score) * 1e9 - event_id) AS event_type, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, round(avg(CASE WHEN score < 0 THEN 1.0 ELSE 0.0 END), 6) AS bad_share
  FROM s WHERE session IS NOT NULL GROUP BY 1, 2)"""


def event_rows(spark, d):
    return E.event_table(sessions(spark, d))


@query(f"WITH {_EVENTS} SELECT * FROM ev")
def event_table(spark, d):
    return event_rows(spark, d)


# A brand stands for a ticker: user u is brand u % 25 + 1, and January's sessions are the panel's first ones
_AT = f"""WITH {_EVENTS}, {PANEL}, x AS (SELECT 'Brand#' || CAST(ev.ticker % 25 + 1 AS VARCHAR) AS ticker, ev.ticker AS user_id, ncal.trading_index * 20 AS trading_index, direction, score, ev.event_type FROM ev JOIN ncal ON ncal.date = ev.session)"""


def placed(spark, d):
    rows = event_rows(spark, d).join(F.broadcast(news_calendar(spark, d).withColumnRenamed("date", "session")), "session")
    return rows.select(F.concat(F.lit("Brand#"), (F.col("ticker") % 25 + 1).cast("string")).alias("ticker"), F.col("ticker").alias("user_id"), (F.col("trading_index") * 20).alias("trading_index"), "direction", "score", "event_type")


@query(f"""{_AT} SELECT x.user_id, x.trading_index, round(b.close / a.close - 1, 6) AS ret, CASE WHEN b.close / a.close - 1 > 0.001 THEN 1e0 WHEN b.close / a.close - 1 <= 0.001 THEN 0e0 END AS up
FROM x LEFT JOIN panel a ON a.ticker = x.ticker AND a.trading_index = x.trading_index + CASE WHEN x.score < 0 THEN 1 ELSE 0 END
LEFT JOIN panel b ON b.ticker = x.ticker AND b.trading_index = x.trading_index + CASE WHEN x.score < 0 THEN 1 ELSE 0 END + 5""")
def event_outcomes_shifted_entry(spark, d):
    rows = E.outcomes(placed(spark, d), panel(spark, d), 5, F.when(F.col("score") < 0, 1).otherwise(0))
    return rows.select("user_id", "trading_index", F.round("ret", 6).alias("ret"), F.when(F.col("ret") > 0.001, 1.0).when(F.col("ret") <= 0.001, 0.0).alias("up"))


@query("""WITH f AS (SELECT event_type AS k, event_id + 500 AS pos, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS y FROM events),
c AS (SELECT *, sum(y) OVER w AS s, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY k ORDER BY pos RANGE UNBOUNDED PRECEDING))
SELECT e.event_id, round((coalesce(c.s, 0) + 5) / (coalesce(c.n, 0) + 10) - 0.5, 8) AS credibility FROM events e ASOF LEFT JOIN c ON c.k = e.event_type AND c.pos <= e.event_id""")
def credibility_asof(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("at"), (F.col("value") > 50).cast("double").alias("y"))
    known = e.withColumn("at", F.col("at") + 500)
    return E.credibility(e.select("k", "at"), known, "k", "at").select(F.col("at").alias("event_id"), F.round("credibility", 8).alias("credibility"))


@query(f"""WITH {DAILY}, o AS (SELECT trading_index + 5 AS trading_index, CASE WHEN level > 180000 THEN 1.0 ELSE 0.0 END AS y FROM daily),
x AS (SELECT daily.date, sum(o.y) OVER w AS s, count(o.y) OVER w AS n FROM daily LEFT JOIN o ON o.trading_index = daily.trading_index WINDOW w AS (ORDER BY daily.trading_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, round(CASE WHEN n > 0 THEN s / n END, 8) AS hit_rate FROM x""")
def recent_hit_rate(spark, d):
    rows = daily(spark, d)
    o = rows.select((F.col("trading_index") + 5).alias("trading_index"), (F.col("level") > 180000).cast("double").alias("y"))
    return rows.join(o, "trading_index", "left").select("date", F.round(S.rolled(F.avg, "y", 20, 1, member=None), 8).alias("hit_rate"))


_AR = ", b AS (SELECT date, CASE WHEN count(r) >= 10 THEN avg(r) END AS rb FROM ret GROUP BY date), ar AS (SELECT ret.ticker, trading_index, r - rb AS ar FROM ret JOIN b ON b.date = ret.date)"
_RET = ", ret AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY ticker ORDER BY trading_index) AS r FROM panel)"
_BIG = "big AS (SELECT DISTINCT ticker, trading_index, CASE WHEN max(score) OVER (PARTITION BY ticker, trading_index) > 200 THEN 'good' ELSE 'other' END AS kind FROM x)"


def big_events(spark, d):
    return placed(spark, d).groupBy("ticker", "trading_index").agg(F.when(F.max("score") > 200, "good").otherwise("other").alias("kind"))


@query(f"{_AT}{_RET}{_AR}, {_BIG}, p AS (SELECT big.ticker, big.trading_index, k, ar.ar FROM big CROSS JOIN (SELECT unnest(range(-10, 21)) AS k) LEFT JOIN ar ON ar.ticker = big.ticker AND ar.trading_index = big.trading_index + k) SELECT ticker, trading_index, CAST(k AS INTEGER) AS k, round(sum(ar) OVER (PARTITION BY ticker, trading_index ORDER BY k), 6) AS car FROM p")
def car_paths(spark, d):
    return E.paths(big_events(spark, d), abnormal(spark, d), 10, 20).select("ticker", "trading_index", "k", F.round("car", 6).alias("car"))


@query(f"{_AT}{_RET}{_AR}, {_BIG}, p AS (SELECT kind, big.trading_index, k, avg(ar.ar) AS m FROM big CROSS JOIN (SELECT unnest(range(-5, 6)) AS k) LEFT JOIN ar ON ar.ticker = big.ticker AND ar.trading_index = big.trading_index + k GROUP BY 1, 2, 3) SELECT kind, CAST(k AS INTEGER) AS k, round(avg(m), 6) AS mean, count(m) AS sessions FROM p GROUP BY 1, 2")
def car_by_type(spark, d):
    p = E.paths(big_events(spark, d), abnormal(spark, d), 5, 5).groupBy("kind", "trading_index", "k").agg(F.avg("ar").alias("m"))
    return p.groupBy("kind", "k").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("m").alias("sessions"))


@query(f"WITH {_SESSIONS} SELECT session, count(*) AS n, string_agg(event_type, ' | ' ORDER BY event_id) AS said FROM s WHERE session IS NOT NULL AND (CAST(ts AS DATE) <> session OR hour(ts) * 60 + minute(ts) < 540) AND abs(score) > 150 GROUP BY session")
def preopen_events(spark, d):
    rows = sessions(spark, d).where("session IS NOT NULL AND abs(score) > 150").where((F.col("ts").cast("date") != F.col("session")) | (F.hour("ts") * 60 + F.minute("ts") < 540))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), " | ")
    return rows.groupBy("session").agg(F.count("*").alias("n"), said.alias("said"))


@query(f"WITH {_SESSIONS}, f AS (SELECT ticker, session, CASE event_type WHEN 'click' THEN 'market' WHEN 'error' THEN 'legal' ELSE 'firm' END AS grp, score FROM s WHERE session IS NOT NULL) SELECT ticker, session, count(*) FILTER (grp = 'market') AS market, count(*) FILTER (grp = 'legal') AS legal, count(*) FILTER (grp = 'firm') AS firm, round(avg(CASE WHEN grp = 'firm' THEN 1.0 ELSE 0.0 END), 6) AS firm_share FROM f GROUP BY 1, 2")
def ticker_news_groups(spark, d):
    f = sessions(spark, d).where("session IS NOT NULL").withColumn("grp", F.when(F.col("event_type") == "click", "market").when(F.col("event_type") == "error", "legal").otherwise("firm"))
    return f.groupBy("ticker", "session").agg(*(F.count_if(F.col("grp") == g).alias(g) for g in ("market", "legal", "firm")), F.round(F.avg((F.col("grp") == "firm").cast("double")), 6).alias("firm_share"))


@query(f"WITH {RETURNS}, z AS (SELECT *, r / nullif(CASE WHEN count(r) OVER w >= 10 THEN stddev_samp(r) OVER w END, 0) AS z FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY trading_index ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), f AS (SELECT *, lead(r) OVER (PARTITION BY ticker ORDER BY trading_index) AS r1 FROM z) SELECT date, ticker, CAST(sign(z) AS INTEGER) AS direction, round(sign(z) * r1, 6) AS signed, CASE WHEN r1 IS NOT NULL THEN CASE WHEN sign(z) * r1 > 0 THEN 1e0 ELSE 0e0 END END AS continued FROM f WHERE abs(z) > 1.5")
def continuation_events(spark, d):
    from quaylark.plans.series import _returns

    rows = _returns(spark, d)
    sd = F.nullif(S.rolled(F.stddev_samp, "r", 60, 10, 1), F.lit(0.0))
    rows = rows.withColumns({"z": F.try_divide("r", sd), "r1": F.lead("r").over(S.by())}).where(F.abs("z") > 1.5)
    signed = F.signum("z") * F.col("r1")
    return rows.select("date", "ticker", F.signum("z").cast("int").alias("direction"), F.round(signed, 6).alias("signed"), F.when(F.col("r1").isNotNull(), (signed > 0).cast("double")).alias("continued"))


_STORY = """WITH RECURSIVE v AS (SELECT vec_id AS id, label AS key, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT id, key, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vec FROM v),
near AS (SELECT a.id, b.id AS id2, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM u a JOIN u b ON a.key = b.key AND b.id < a.id AND b.id >= a.id - 72),
best AS (SELECT id, id2 AS parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, id2) AS k FROM near WHERE sim >= 0.15) WHERE k = 1),
tree AS (SELECT id, id AS root, 1 AS rank FROM u WHERE id NOT IN (SELECT id FROM best) UNION ALL SELECT best.id, tree.root, tree.rank + 1 FROM best JOIN tree ON best.parent = tree.id)
SELECT id, root, CAST(rank AS INTEGER) AS rank FROM tree"""


def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", norm).select("id", "key", F.transform("e", lambda x: x / F.col("n")).alias("vec"))


@query(_STORY)
def story_clusters(spark, d):
    return E.stories(unit_vectors(spark, d).withColumn("at", F.col("id")), 72, 0.15)


@query("""WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.id, b.id AS near, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) <= 5""")
def embedding_topk(spark, d):
    u = unit_vectors(spark, d)
    # the rows of a label are dealt to salts, each query goes to all of them: the nearest of a salt, then those of these
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = u.where("id % 100 = 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = u.select("key", F.col("id").alias("near"), F.col("vec").alias("v2"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    dot = F.aggregate(F.zip_with("vec", "v2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = asked.join(rows, ["key", "salt"]).where("id <> near").select("id", "near", "salt", F.round(dot, 9).alias("s"))
    best = pairs.withColumn("k", F.row_number().over(Window.partitionBy("id", "salt").orderBy(F.desc("s"), "near"))).where("k <= 5")
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "near")))
    return ranked.where("k <= 5").select("id", "near", F.round("s", 6).alias("sim"))


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM v GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)
SELECT m.label, CAST(i - 1 AS INTEGER) AS i, round(m / n, 6) AS x FROM m JOIN n ON n.label = m.label""")
def group_mean_vector(spark, d):
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.select("label", "i", F.round(F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))), 6).alias("x"))


#: Scenarios of the sweep: slots, sessions held, cost of a trade, least return that is a signal.
SCENARIOS = {
    "base": (10, 5, 0.004, 0.1), "no cost": (10, 5, 0.0, 0.1), "half cost": (10, 5, 0.002, 0.1), "high cost": (10, 5, 0.008, 0.1), "five slots": (5, 5, 0.004, 0.1), "twenty slots": (20, 5, 0.004, 0.1),
    "hold 3": (10, 3, 0.004, 0.1), "hold 10": (10, 10, 0.004, 0.1), "low bar": (10, 5, 0.004, 0.05), "high bar": (10, 5, 0.004, 0.2), "no cost, hold 10": (10, 10, 0.0, 0.1),
}


def _signals(spark, d, scenarios):
    """Signals of each scenario: a return above its bar, worth the return of the sessions it holds."""
    from quaylark.plans.series import _returns

    rows, out = _returns(spark, d), None
    for hold in sorted({s[1] for s in scenarios.values()}):
        mine = spark.createDataFrame([(n, *s) for n, s in scenarios.items() if s[1] == hold], "scenario string, slots int, hold int, cost double, bar double")
        found = rows.withColumn("ret", F.exp(S.ahead("r", 1, hold)) - 1).where("ret IS NOT NULL").select(F.col("trading_index").alias("t"), F.col("r").alias("priority"), "ret", "ticker")
        found = found.join(F.broadcast(mine), F.col("priority") > F.col("bar"))  # a scenario a row
        out = found if out is None else out.unionByName(found)
    return out


def _sweep_sql(scenarios, out):
    holds = sorted({s[1] for s in scenarios.values()})
    values = ", ".join(f"('{n}', {s[0]}, {s[1]}, {s[2]}e0, {s[3]}e0)" for n, s in scenarios.items())
    ahead = ", ".join(f"CASE WHEN count(r) OVER h{h} = {h} THEN exp(sum(r) OVER h{h}) - 1 END AS f{h}" for h in holds)
    windows = ", ".join(f"h{h} AS (PARTITION BY ticker ORDER BY trading_index ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)" for h in holds)
    pick = " ".join(f"WHEN {h} THEN f{h}" for h in holds)
    return f"""WITH RECURSIVE {RETURNS}, fw AS (SELECT ticker, trading_index, r, {ahead} FROM ret WINDOW {windows}),
sc AS (SELECT * FROM (VALUES {values}) v(scenario, slots, hold, cost, bar)),
sig AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY t, r DESC, ret DESC) AS n FROM (SELECT scenario, slots, hold, cost, trading_index AS t, r, CASE hold {pick} END AS ret FROM fw JOIN sc ON r > bar) WHERE ret IS NOT NULL),
st AS (SELECT scenario, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS trades, list_transform(range(slots), lambda k: {{'u': CAST(-1 AS BIGINT), 'k': k, 'v': 100e0 / slots}}) AS s FROM sc WHERE scenario IN (SELECT scenario FROM sig)
UNION ALL SELECT st.scenario, sig.n, st.trades + CASE WHEN s[1].u < t THEN 1 ELSE 0 END,
  CASE WHEN s[1].u < t THEN list_sort(list_append(s[2:], {{'u': CAST(t + hold AS BIGINT), 'k': s[1].k, 'v': s[1].v * (1 + ret - cost)}})) ELSE s END
FROM st JOIN sig ON sig.scenario = st.scenario AND sig.n = st.n + 1),
e AS (SELECT scenario, trades, list_sum(list_transform(s, lambda x: x.v)) AS value FROM st QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n DESC) = 1) {out}"""


_TWO = {"ten": (10, 5, 0.004, 0.1), "free": (10, 5, 0.0, 0.1)}


@query(_sweep_sql(_TWO, "SELECT scenario, trades, round(value, 6) AS value FROM e"))
def portfolio_sim(spark, d):
    return E.simulate_runs(_signals(spark, d, _TWO), ["scenario"]).select("scenario", "trades", F.round("value", 6).alias("value"))


@query(_sweep_sql(SCENARIOS, "SELECT scenario, trades, round(value, 6) AS value, value > (SELECT value FROM e WHERE scenario = 'base') AS better FROM e"))
def robustness_sweep(spark, d):
    """The portfolio under eleven scenarios, and which of them beat the base."""
    runs = E.simulate_runs(_signals(spark, d, SCENARIOS), ["scenario"])
    base = runs.where("scenario = 'base'").select(F.col("value").alias("base"))  # one row
    return runs.join(F.broadcast(base)).select("scenario", "trades", F.round("value", 6).alias("value"), (F.col("value") > F.col("base")).alias("better"))


@query(f"WITH {RETURNS}, b AS (SELECT trading_index, avg(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY 1) SELECT trading_index, round(sum(r) OVER (ORDER BY trading_index), 6) AS log_value FROM b")
def basket(spark, d):
    from quaylark.plans.series import _returns

    b = _returns(spark, d).where("r IS NOT NULL").groupBy("trading_index").agg(F.avg("r").alias("r"))
    return b.select("trading_index", F.round(F.sum("r").over(Window.orderBy("trading_index")), 6).alias("log_value"))
