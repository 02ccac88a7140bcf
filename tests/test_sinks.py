import zipfile

import pytest
from pyspark.sql import functions as F

from quaylark import session
from quaylark.functions import text as X
from quaylark.operators import ordering
from quaylark.sources import readers, writers
from quaylark.streaming import streams


def test_reports_raise_and_never_cut(spark, tmp_path):
    df = spark.range(12).select(F.col("id").alias("k"))
    assert len(writers.markdown(df, 12).splitlines()) == 14
    for call in (lambda: writers.markdown(df, 11), lambda: writers.dashboard("/*DATA*/", {"t": df}, f"{tmp_path}/d.html", 11), lambda: writers.write_report(df, f"{tmp_path}/r.csv", 11), lambda: writers.write_workbook(df, f"{tmp_path}/w.xlsx", most=11)):
        with pytest.raises(ValueError):
            call()


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1, None), ("c & \"d\"", 2, "good")], "text string, n int, label string")
    assert writers.write_workbook(df, f"{tmp_path}/w.xlsx", {"label": ["good", "bad"]}) == 2
    sheet = zipfile.ZipFile(f"{tmp_path}/w.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert 'sqref="C2:C3"' in sheet and "<formula1>\"good,bad\"</formula1>" in sheet
    rows = [r for _, _, r in readers.workbook_cells(open(f"{tmp_path}/w.xlsx", "rb").read())]
    assert rows[0][:3] == ["text", "n", "label"] and rows[1][:2] == ["a<b", "1"] and rows[2][:3] == ["c & \"d\"", "2", "good"]


def test_package(tmp_path):
    (tmp_path / "src" / "__pycache__").mkdir(parents=True)
    for name in ("a.py", "b.txt", "__pycache__/c.py"):
        (tmp_path / "src" / name).write_text("x")
    assert writers.package([str(tmp_path / "src")], f"{tmp_path}/p.zip", (".py",)) == ["src/a.py"]
    assert zipfile.ZipFile(f"{tmp_path}/p.zip").namelist() == ["src/a.py"]


def test_upsert_leaves_other_keys(spark, tmp_path):
    at = f"{tmp_path}/t"
    writers.upsert(spark.createDataFrame([(k, "old") for k in range(50)], "k long, v string"), at, ["k"])
    writers.upsert(spark.createDataFrame([(k, "new") for k in range(45, 60)], "k long, v string"), at, ["k"])
    got = {r.k: r.v for r in writers.read_keyed(spark, at).collect()}
    assert got == {k: "new" if k >= 45 else "old" for k in range(60)}


def test_other_settings_are_refused(tmp_path):
    first = streams.settle(str(tmp_path), {"a": 1, "b": 2})
    assert streams.settle(str(tmp_path), {"b": 2, "a": 1}) == first
    with pytest.raises(streams.SettingsChanged):
        streams.settle(str(tmp_path), {"a": 2, "b": 2})


def test_one_writer(tmp_path):
    with streams.single_writer(str(tmp_path)):
        with pytest.raises(RuntimeError), streams.single_writer(str(tmp_path)):
            pass
    with streams.single_writer(str(tmp_path)):
        pass


def test_fetch():
    pages = {"a": (200, b"<p>x</p>"), "b": (200, b'{"html": "<p>y</p>"}'), "c": (404, b""), "d": (200, b"x" * 20), "e": (200, b"Just a moment..."), "f": (503, b"")}
    waits = []
    fetch = lambda u: streams.fetch_page(lambda url: pages[url], u, most=19, wait=waits.append)
    pages["b"] = (200, b'{"html":"<p>y"}')
    assert [fetch(u) for u in "abcdef"] == [("ok", "<p>x</p>"), ("ok", "<p>y"), ("gone", ""), ("too large", ""), ("challenge", ""), ("failed", "")]
    assert waits == [0, 0, 0, 0, 0, 1, 2, 0, 1, 2]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_running_sums_and_quantiles(spark):
    rows = spark.createDataFrame([(k % 3, float(k * k % 101)) for k in range(500)] + [(4, None), (5, 1.0)], "g int, v double")
    got = {(r.g, r.share): r.value for r in ordering.quantiles(rows, "v", [0.1, 0.5, 1.0], ["g"]).collect()}
    want = rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.1, 0.5, 1.0)))).alias("q")).where("q IS NOT NULL").collect()
    for r in want:
        for share, value in zip((0.1, 0.5, 1.0), r.q):
            assert abs(got[(r.g, share)] - value) < 1e-9
    assert ordering.quantile_row(rows.limit(0), ["v"], [0.5]) == {"v": [None]}
    sums = ordering.running(spark.range(1000).select(F.col("id").alias("k"), F.lit(2).alias("n")), ["k"], "n").collect()
    assert all(r.before == 2 * r.k for r in sums) and len(sums) == 1000
    least = ordering.least_from(spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 37 % 300).alias("x")), ["k"], "x").collect()
    after, best = {}, 10**9
    for k in reversed(range(300)):
        after[k] = best = min(best, k * 37 % 300)
    assert all(r.least == after[r.k] for r in least)


def test_text_rules(spark):
    df = spark.createDataFrame([("the council with licence rules",), ("the license",), ("with license",)], "t string")
    rule = X.legal_filter(F.col("t"), ["the "], ["license"], ["from "], ["must"], ["council"])
    assert [r[0] for r in df.select(rule).collect()] == [False, True, False]
    known, unknown = X.codes(F.lit("ABC XYZ AB ABC 12A"), ["ABC", "12A"])
    assert df.select(known, unknown).first()[:] == (["12A", "ABC"], ["XYZ"])
