"""The small fixtures with values derived by hand, and invariants."""

import datetime as dt
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.functions import text as X
from quaylark.operators import events as E
from quaylark.operators import relational as R
from quaylark.operators import series as S
from quaylark.operators import stats as T
from quaylark.sources import readers, writers
from quaylark.streaming import streams

DAY = dt.date


def dates(spark, *days):
    return S.calendar(spark.createDataFrame([(d,) for d in days], "date date"))


def test_session_mapping(spark):
    cal = dates(spark, DAY(2024, 1, 4), DAY(2024, 1, 5), DAY(2024, 1, 8), DAY(2024, 1, 9))
    want = {"2024-01-04 08:00:00": DAY(2024, 1, 4), "2024-01-04 14:44:59": DAY(2024, 1, 4), "2024-01-04 14:45:00": DAY(2024, 1, 5), "2024-01-05 15:00:00": DAY(2024, 1, 8), "2024-01-06 09:00:00": DAY(2024, 1, 8), "2024-01-09 14:45:00": None, "2023-12-30 10:00:00": DAY(2024, 1, 4)}
    rows = spark.createDataFrame([(k,) for k in want], "k string").withColumn("ts", F.col("k").cast("timestamp"))
    assert {r.k: r.session for r in S.to_session(rows, "ts", cal).collect()} == want


def test_decay(spark):
    rows = spark.range(14).select(F.lit("a").alias("ticker"), F.col("id").alias("trading_index"), F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("x"))
    got = [r.d for r in rows.withColumn("d", S.decayed("x", 3)).orderBy("trading_index").collect()]
    assert got[0] == 1 and got[3] == 0.5 and got[6] == 0.25 and got[9] == 0.125 and got[10] == 0


def test_three_classes(spark):
    z = [-0.6, -0.5, 0.0, 0.5, 0.51, None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(z)], "k int, z double").withColumn("y", R.three_classes(F.col("z")))
    assert [r.y for r in rows.orderBy("k").collect()] == [-1, 0, 0, 0, 1, None]


def test_islands(spark):
    days = [DAY(2024, 1, 2), DAY(2024, 1, 4), DAY(2024, 1, 5), DAY(2024, 1, 8)]
    rows = S.islands(spark.createDataFrame([(d,) for d in days], "d date"), "d", 2)
    assert [r.island for r in rows.orderBy("d").collect()] == [1, 1, 1, 2]


def test_rank_share(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double").withColumn("g", F.lit(1))
    assert sorted((r.s for r in rows.withColumn("s", S.rank_share("x", ["g"])).collect()), key=lambda v: (v is None, v)) == [0.25, 0.625, 0.625, 1.0, None]


def test_credibility(spark):
    known = spark.createDataFrame([("a", 5, 1.0), ("a", 8, 0.0)], "k string, at long, y double")
    probes = spark.createDataFrame([("a", 4), ("a", 5), ("a", 8)], "k string, at long")
    got = {r["at"]: r.credibility for r in E.credibility(probes, known, "k", "at").collect()}
    assert got[4] == 0 and got[5] == pytest.approx(6 / 11 - 0.5) and got[8] == pytest.approx(0.0)


def test_canonical_url(spark):
    urls = {"HTTPS://www.Example.vn/a-1.chn/?utm=1#x": "https://example.vn/a-1.chn", "//x.vn": "https://x.vn/", "x.vn/b?q": "https://x.vn/b", "": None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("c", X.canonical_url(F.col("u")))
    assert {r.u: r.c for r in rows.collect()} == urls


def test_ecdf(spark):
    rows = spark.createDataFrame([(True, 1.0), (True, 2.0), (True, 2.0), (True, 4.0), (False, 0.0), (False, 1.0), (False, 2.0), (False, 3.0), (False, 4.0)], "ref boolean, x double").withColumn("g", F.lit(0))
    got = {r.x: r.e for r in S.ecdf(rows, "x", F.col("ref"), ["g"], "e").where("not ref").collect()}
    assert got == {0.0: 0.0, 1.0: 0.25, 2.0: 0.75, 3.0: 0.75, 4.0: 1.0}


def test_bh(spark):
    rows = T.bh(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double"), "p")
    got = {r.p: round(r.q, 4) for r in rows.collect()}
    assert got == {0.01: 0.04, 0.03: 0.0533, 0.04: 0.0533, 0.5: 0.5}


def test_stories(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = spark.createDataFrame([(0, "t", 0, a), (1, "t", 10, a), (2, "t", 20, b), (3, "t", 100, a)], "id long, key string, at long, vec array<double>")
    assert {r.id: (r.rank, r.root) for r in E.stories(rows, 72, 0.92).collect()} == {0: (1, 0), 1: (2, 0), 2: (1, 2), 3: (1, 3)}


def test_portfolio(spark):
    signals = spark.createDataFrame([("s", 0, 1.0, 0.1), ("s", 1, 1.0, 0.5), ("s", 3, 1.0, 0.0)], "run string, t long, priority double, ret double")
    got = E.simulate(signals, ["run"], 1, 2, 0.004).first()
    assert got.trades == 2 and got.value == pytest.approx(100 * 1.096 * 0.996)


def test_folds_are_purged(spark):
    cal = dates(spark, *(DAY(2024, 1, 1) + dt.timedelta(days=k) for k in range(900)))
    for h in (1, 5):
        folds = T.walk_forward_folds(cal, "2025-04-01", 3, h).join(cal, "date")
        ends = {(r.fold, r.part): (r.a, r.b) for r in folds.groupBy("fold", "part").agg(F.min("trading_index").alias("a"), F.max("trading_index").alias("b")).collect()}
        for f in (1, 2, 3):
            assert ends[f, "train"][1] + h + 5 < ends[f, "val"][0] and ends[f, "fit"][1] + h + 5 < ends[f, "test"][0] and ends[f, "val"][1] + h + 5 < ends[f, "test"][0]


def test_kappa_and_auc(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")
    assert T.kappa(rows, "a", "b").first().kappa == pytest.approx(0.5)
    assert T.auc(rows, "a", "b").first().auc == pytest.approx(0.75)


def test_t_p_value():
    assert T.t_p_value(0.0, 10) == pytest.approx(1.0)
    assert T.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert T.t_p_value(1.0, 1) == pytest.approx(0.5, abs=1e-9)


def test_features_are_causal(spark):
    rng = random.Random(3)
    rows = [("a", k, rng.random()) for k in range(60)]
    later = [(t, k, x if k < 40 else x + 100) for t, k, x in rows]
    feature = lambda data: {r.trading_index: (r.m, r.z, r.d) for r in spark.createDataFrame(data, "ticker string, trading_index long, x double").select("trading_index", S.rolled(F.avg, "x", 5).alias("m"), S.z_score("x", 20, 10, 1).alias("z"), S.decayed("x", 3).alias("d")).collect()}
    a, b = feature(rows), feature(later)
    assert all(a[k] == b[k] for k in range(40)) and a[40] != b[40]


def test_bootstrap_draws(spark):
    draws = T.block_draws(spark, 100, 10, 20, 1)
    assert {r.n for r in draws.groupBy("rep").agg(F.sum("times").alias("n")).collect()} == {100}
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, T.block_draws(spark, 100, 10, 20, 1).collect()))


def test_nfc_and_phrases(spark):
    rows = spark.createDataFrame([("é \n A",), ("é a",), ("đấtđ LUẬT",), (None,)], "t string")
    got = rows.select(X.text_hash(F.col("t")).alias("h"), X.has_phrase(F.col("t"), "đất").alias("p"), X.has_phrase(F.col("t"), "luật").alias("q")).collect()
    assert got[0].h == got[1].h != "" and got[3].h == "" and got[2].p is False and got[2].q is True


def test_tagging_and_entities(spark):
    df = spark.createDataFrame([(1, "The MIT License of ABC; license"), (2, "abc token"), (3, None)], "id long, t string")
    tags = {r.id: dict(r.tags) for r in X.tag(df, "t", {"short": ["license"], "long": ["mit license"]}).collect()}
    assert tags == {1: {"long": ["mit license"], "short": ["license"]}, 2: {}, 3: {}}
    found = sorted(map(tuple, X.match_entities(df, "id", "t", {"ABC": ["alpha"], "LIC": ["mit license"]}, {"ABC": ["license"]}).collect()))
    assert found == [(1, "ABC", "ABC"), (1, "LIC", "mit license")]


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="Prices" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>day</t></si><si><r><t>ti</t></r><r><t>cker</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>05/01/2024</t></is></c><c r="B2"><v>9</v></c><c r="C2"><v>7.5</v></c></row><row><c r="B3"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook())
    cells = readers.read_workbooks(spark, f"{tmp_path}/*.xlsx", ["Prices"])
    rows = readers.sheet_table(cells, ["day", "ticker"]).collect()
    assert [(r.day, r.ticker) for r in rows] == [("05/01/2024", "7.5")]
    prices = readers.price_rows(spark.createDataFrame([("05/01/2024", "ABC", "7.5", "x"), ("bad", "D", "1", "1")], "d string, t string, c string, v string"), {"d": "date", "t": "ticker", "c": "close", "v": "volume"})
    assert [(r.date, r.close, r.volume) for r in prices.collect()] == [(DAY(2024, 1, 5), 7.5, None)]


def test_csv_logs_and_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿url,title\nu1,"line one\nline ""two"""\nu2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("url,extra\nu3,e\n", encoding="utf-8")
    rows = readers.read_files(spark, [(f"{tmp_path}/a.csv", {"src": "a"}), (f"{tmp_path}/b.csv", {"src": "b"})], ["url", "title", "extra"]).collect()
    assert [(r.url, r.title, r.extra, r.src, r.file_order) for r in rows] == [("u1", 'line one\nline "two"', None, "a", 0), ("u2", None, None, "a", 0), ("u3", None, "e", "b", 1)]
    import hashlib
    import json

    line = lambda k, s, d: json.dumps({"key": k, "saved": s, "sum": hashlib.sha256(d.encode()).hexdigest(), "data": d})
    (tmp_path / "log.jsonl").write_text("\n".join([line("a", "1", '{"n": 1}'), line("a", "2", '{"n": 2}'), line("b", "1", '{"n": 3}'), line("b", "2", '{"n": 4}')[:-9]]))
    assert {r.key: r.data.n for r in readers.read_log(spark, f"{tmp_path}/log.jsonl", "n long").collect()} == {"a": 2, "b": 3}
    assert readers.embedded_table(spark, "A|1\nB|2", ["t", "n"], "t", 2).count() == 2
    with pytest.raises(ValueError):
        readers.embedded_table(spark, "A|1\nA|2", ["t", "n"], "t")
    np.save(tmp_path / "m.npy", np.eye(3, dtype="float16"))
    got = {r.k: list(r.vec) for r in readers.read_vectors(spark, f"{tmp_path}/m.npy", spark.createDataFrame([("x", 2), ("y", 0), ("z", 1)], "k string, o int"), "o", "k").collect()}
    assert got == {"y": [1, 0, 0], "z": [0, 1, 0], "x": [0, 0, 1]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert writers.append_new(df, f"{tmp_path}/t", ["k"]) == 2 and writers.append_new(df, f"{tmp_path}/t", ["k"]) == 0
    assert writers.append_new(df.withColumn("k", F.col("k") + 1), f"{tmp_path}/t", ["k"]) == 1
    assert writers.write_report(df, f"{tmp_path}/r.csv") == 2 and open(f"{tmp_path}/r.csv", "rb").read(3) == b"\xef\xbb\xbf"
    assert writers.markdown(df).splitlines()[2] == "| 1 | a |"
    writers.write_routed(df, F.when(F.col("k") == 1, "related").otherwise("failed"), f"{tmp_path}/routed")
    assert {r.route for r in spark.read.parquet(f"{tmp_path}/routed").collect()} == {"related", "failed"}
    writers.dashboard("<script>x = /*DATA*/</script>", {"t": df}, f"{tmp_path}/d.html")
    assert '"v": "a"' in open(f"{tmp_path}/d.html").read()


def test_stream_stories_are_those_of_the_batch(spark):
    from quaylark.plans import registry

    d = "/root/testdata/sf0.001"
    batch = {r.id: r.root for r in registry.QUERIES["story_clusters"](spark, d).collect()}
    assert {r.id: r.root for r in registry.QUERIES["stream_stories"](spark, d).collect()} == batch


def test_crawl_stops():
    pages = {1: ["a", "b"], 2: ["b", "c"], 3: ["a"], 4: ["b"], 5: ["c"], 6: ["z"]}
    state, seen = {}, set()
    got = streams.crawl(lambda p: [{"url": u} for u in pages.get(p, [])], seen, state)
    assert [r["url"] for r in got] == ["a", "b", "c"] and state["next"] == 6
    assert [r["url"] for r in streams.crawl(lambda p: [{"url": u} for u in pages.get(p, [])], seen, state)] == ["z"]
    assert streams.run_id({"a": 1, "b": 2}) == streams.run_id({"b": 2, "a": 1}) != streams.run_id({"a": 2, "b": 2})


def test_quantiles_of_earlier_groups(spark):
    from quaylark.operators import ordering

    rng = random.Random(9)
    rows = [(g, rng.choice([None, 1.0, 2.0, 2.0, float(rng.randrange(50)), rng.random()])) for g in (1, 2, 2, 2, 3, 5, 5, 9) for _ in range(20)]
    known = lambda g: [v for k, v in rows if k < g and v is not None]
    for share in (0.0, 0.37, 0.8, 1.0):
        got = {r.g: r.value for r in ordering.earlier_quantile(spark.createDataFrame(rows, "g long, v double"), "g", "v", share).collect()}
        assert got.keys() == {2, 3, 5, 9}
        assert all(abs(x - np.quantile(known(g), share)) < 1e-12 for g, x in got.items())
    assert ordering.earlier_quantile(spark.createDataFrame(rows, "g long, v double").limit(0), "g", "v", 0.5).collect() == []


def events_of(spark, path, rows):
    """A folder with a table of events (event_id, user_id, event_type, value) on 2024-01-02 and the days after."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.withColumns({"ts": F.lit("2024-01-02 09:00:00").cast("timestamp_ntz"), "props": F.lit("{}")}).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_classes_of_scores_that_are_halves_in_decimal_form_only(spark, tmp_path):
    from quaylark.plans import registry

    # (29.98 - 50) / 40 is -0.5005, but times 1000 it is above -500.5; 70.02 likewise
    d = events_of(spark, tmp_path / "d", [(1, 1, "view", 29.98), (2, 1, "view", 70.02), (3, 1, "view", 90.02), (4, 1, "view", None), (5, 1, "view", float("nan"))])
    rows = {r.event_id: (r["class"], r.big) for r in registry.QUERIES["three_class_flags"](spark, d).where("event_id < 5").collect()}
    import duckdb

    sql = duckdb.sql(registry.ORACLES["three_class_flags"].replace("FROM events", f"FROM read_parquet('{d}/events.parquet/*.parquet')")).fetchall()
    assert rows == {k: (c, b) for k, c, b in sql if k < 5} and rows[1] == (0, 0.0)


def test_places_of_means_that_are_halves(spark, tmp_path):
    from quaylark.plans import registry

    # 32 values with a mean of 55.0771875 exactly: SQL's sum of doubles decides; users without a known value come last
    low = [(k, 1, "view", v) for k, v in enumerate([0.07, 10.33, 1762.07 - 10.33] + [0.0] * 28 + [0.4 - 0.07])]
    d = events_of(spark, tmp_path / "d", low + [(40, 2, "view", 60.0), (41, 3, "error", None), (42, 4, "view", 60.0)])
    rows = {r.user_id: r for r in registry.QUERIES["unified_output"](spark, d).collect()}
    assert {k: (r.tone, r.place, r.errors) for k, r in rows.items()} == {1: (rows[1].tone, 0.25, 0), 2: (60.0, 0.625, 0), 4: (60.0, 0.625, 0), 3: (None, 1.0, 1)}


def test_sums_of_doubles_in_order_whatever_the_partitions(spark):
    from quaylark.operators import ordering

    rng = random.Random(4)
    rows = [(k % 7, k, round(rng.uniform(-100, 500), 2)) for k in range(5000)]
    want = dict.fromkeys(range(7), 0.0)
    for g, _, v in rows:
        want[g] += v
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, k long, v double").repartition(5)
    assert {r.g: r.added for r in ordering.ordered_sums(df, "g", "k", "v").collect()} == want


def test_places_of_halves_are_those_of_sql_in_one_thread(spark, tmp_path):
    import duckdb

    from quaylark.plans import registry

    rng, rows = random.Random(5), []
    for u in range(200):  # 32 values each: every second mean is a half of the sixth place
        rows += [(u * 32 + k, u, "error" if k % 9 == 0 else "purchase", round(rng.uniform(-100, 500), 2)) for k in range(32)]
    d = events_of(spark, tmp_path / "d", rows)
    spark.read.parquet(f"{d}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/e/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet') ORDER BY event_id")
    want = {r[0]: tuple(r) for r in con.execute(registry.ORACLES["unified_output"]).fetchall()}
    got = {r.user_id: (r.user_id, r.tone, r.errors, r.best, r.place) for r in registry.QUERIES["unified_output"](spark, f"{tmp_path}/e").collect()}
    assert got == want


def test_exact_halves_don_t_depend_on_the_order_of_rows(spark):
    from quaylark.plans.tables import ratio, rounded

    rows = spark.createDataFrame([(1762470, 32000, 6), (-1, 200000, 5), (-3, 200000, 5), (43644, 32000, 5), (0, 7, 5)], "a long, b long, k int")
    got = [(r.x, r.y) for r in rows.select(ratio(F.col("a"), F.col("b"), 6).alias("x"), ratio(F.col("a"), F.col("b"), 5).alias("y")).collect()]
    assert got == [(55.077188, 55.07719), (-5e-06, -1e-05), (-1.5e-05, -2e-05), (1.363875, 1.36388), (0.0, 0.0)]
    assert spark.createDataFrame([(0.5005,), (-2.5,), (None,), (1e300,)], "x double").select(rounded(F.col("x"), 3).alias("x")).collect() == [(0.5,), (-2.5,), (None,), (1e300,)]


def test_news_heat_gap_of_exact_halves(spark, tmp_path):
    from fractions import Fraction
    from math import floor

    from quaylark.plans import registry

    rng = random.Random(6)
    scores = [rng.randrange(-10000, 40000) for _ in range(321)]  # one item a ticker: of 320 others, an eighth of the gaps are halves
    d = events_of(spark, tmp_path / "d", [(k, k, "view", (5000 + s) / 100) for k, s in enumerate(scores)] + [(900, 900, "view", 50.0)])
    later = F.when(F.col("event_id") == 900, F.lit("2024-01-05 09:00:00").cast("timestamp_ntz")).otherwise(F.col("ts"))
    spark.read.parquet(f"{d}/events.parquet").withColumn("ts", later).write.parquet(f"{tmp_path}/e/events.parquet")
    gaps = [Fraction(321 * s - sum(scores), 32000) * 10**5 for s in scores]
    want = {k: (1 if g >= 0 else -1) * floor(abs(g) + Fraction(1, 2)) / 1e5 for k, g in enumerate(gaps)}
    assert sum(g.denominator == 2 for g in gaps) > 20
    assert {r.ticker: r.tone_gap for r in registry.QUERIES["news_heat_context"](spark, f"{tmp_path}/e").collect()} == want


def test_stream_stories_of_a_table_of_several_files(spark, tmp_path):
    from quaylark.plans import registry

    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/embeddings.parquet").repartition(3, "vec_id").sortWithinPartitions(F.xxhash64("vec_id")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(list((tmp_path / "embeddings.parquet").glob("*.parquet"))) > 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: r.root for r in registry.QUERIES["stream_stories"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r.id: r.root for r in registry.QUERIES["story_clusters"](spark, source).collect()}


def test_requests_of_texts_that_differ_in_their_middle(spark, tmp_path):
    from quaylark.plans import registry

    a, b = "word " * 2000, "end " * 2000
    rows = [(1, a + "x" + b, "s"), (2, a + "token" + b, "s"), (3, a + "y" + b, "s"), (4, a + "y" + b, "t"), (5, "short", "s"), (6, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.event_type, r.scope): (r.rows_, r.requests) for r in registry.QUERIES["label_requests"](spark, str(tmp_path)).collect()}
    assert got == {("plain", "single"): (3, 3), ("plain", "MULTI"): (2, 1), ("secret", "single"): (1, 1)}


def test_novelty_at_the_borders_of_blocks_and_bands(spark, tmp_path):
    import duckdb

    from quaylark.plans import registry

    rng, words = random.Random(8), [f"{a}{b}" for a in "abcdefgh" for b in "xyzuvw"]
    ids = [-1, 0, 1, 199, 200, 201, 799, 800, 801, 998, 999, 1000, 1001, 1199, 1200, 1201, 1400, 1999, 2000, 2199, 2200, 5000]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice(["s", "s", "t", None])) for i in ids]
    rows += [(1001, "ax by cz", "s"), (1002, None, "s"), (1003, "", "s"), (1004, "1 2 3", "s"), (1005, rows[11][1], "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(registry.ORACLES["novelty_cosine"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).fetchall()
    got = [(r.doc_id, r.novelty) for r in registry.QUERIES["novelty_cosine"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(ids) + 4
