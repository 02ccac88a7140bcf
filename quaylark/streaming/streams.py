"""Structured Streaming forms of the incremental parts: windows, late items, idempotent results, story state, attempts,
outcomes that arrive later, page crawls.

Sources give naive local times; event time needs an instant, so they are cast under the session's zone (UTC)."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.session import shared_dir, ship


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table, which is one Parquet file or a folder of them, as a stream; all there is now is one batch."""
    # as a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def event_stream(spark: SparkSession, path: str, files: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder as a stream with event time ts."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, width: str, late: str, keys: list[str]) -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(rows: DataFrame, width: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bursts(rows: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Runs of items with less than `gap` between them."""
    return rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))


def first_of_each(rows: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def outcomes_later(items: DataFrame, outcomes: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Items with the outcome of their key that arrives up to `within` after them: state is kept no longer than that."""
    a = items.withWatermark("ts", late).alias("a")
    b = outcomes.withWatermark("known_at", late).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.known_at") >= F.col("a.ts")) & (F.col("b.known_at") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on).select("a.*", "b.outcome", "b.known_at")


def assign_stories(rows: DataFrame, look_back_s: float, threshold: float) -> DataFrame:
    """id, key, root: stories assigned one item after another, with each key's items of the last look_back_s seconds as state.
    rows: key, id, ts, vec (unit vector)."""
    ship(rows.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past = json.loads(state.get[0]) if state.exists else []
        out = []
        # a key's items of a batch come in parts that aren't in order
        for r in pd.concat(list(parts)).sort_values(["t", "id"]).itertuples():
            past = [p for p in past if p[0] >= r.t - look_back_s]
            best = max(((round(sum(x * y for x, y in zip(r.vec, p[2])), 9), -p[0], -p[1], p[3]) for p in past), default=None)
            root = best[3] if best and best[0] >= threshold else r.id
            past.append([r.t, r.id, [float(x) for x in r.vec], int(root)])
            out.append((r.id, key[0], root))
        state.update((json.dumps(past),))
        yield pd.DataFrame(out, columns=["id", "key", "root"])

    flat = rows.withWatermark("ts", f"{int(look_back_s)} seconds").select("key", "id", (F.unix_micros("ts") / 1e6).alias("t"), "vec")
    kind = dict(rows.dtypes)["key"]
    return flat.groupBy("key").applyInPandasWithState(step, f"id long, key {kind}, root long", "past string", "append", "NoTimeout")


def attempts(rows: DataFrame, most: int) -> DataFrame:
    """key, attempt, allowed: each request is counted in state before it is made, so a crash can't grant more than `most`."""
    ship(rows.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        for pdf in parts:
            n = len(pdf)
            yield pd.DataFrame({"key": [key[0]] * n, "attempt": range(done + 1, done + n + 1), "allowed": [k <= most for k in range(done + 1, done + n + 1)]})
            done += n
        state.update((done,))

    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, attempt long, allowed boolean", "done long", "append", "NoTimeout")


def run_id(settings: dict) -> str:
    """The settings' digest: a checkpoint belongs to one set of settings."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def checkpoint_of(spark: SparkSession, name: str, settings: dict) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{run_id(settings)}"


class SettingsChanged(RuntimeError):
    """A run was to go on with other settings than it began with."""


def settle(folder: str, settings: dict) -> str:
    """The run's id. The first run writes its settings into folder; a later run with other settings is refused."""
    path, said = Path(folder) / "settings.json", json.dumps(settings, sort_keys=True)
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as file:
            file.write(said)
    except FileExistsError:
        if path.read_text(encoding="utf-8") != said:
            raise SettingsChanged(f"{folder} was begun with other settings") from None
    return run_id(settings)


@contextmanager
def single_writer(folder: str):
    """Hold the writer's lock of a folder; a second writer is refused while it is held."""
    lock = Path(folder) / "writer.lock"
    lock.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"another writer holds {lock}") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        lock.unlink(missing_ok=True)


def fetch_page(get: Callable[[str], tuple[int, bytes]], url: str, most: int = 8 << 20, tries: int = 3, wait: Callable[[int], None] = lambda k: None) -> tuple[str, str]:
    """(status, html) of a page: ok, gone, too large, challenge or failed. get gives a status and at most the bytes it read; wait is
    called before each request, so it throttles and backs off. A page wrapped in JSON is taken out of it."""
    status = "failed"
    for k in range(tries):
        wait(k)
        try:
            code, data = get(url)
        except OSError:
            continue
        if code in (404, 410):
            return "gone", ""
        if code >= 400:
            continue
        if len(data) > most:
            return "too large", ""
        text = data.decode("utf-8", "replace")
        if text.lstrip().startswith("{"):
            try:
                wrapped = json.loads(text)
                text = next((v for key in ("html", "content", "data") if isinstance(v := wrapped.get(key), str)), "")
            except ValueError:
                text = ""
        low = text[:4000].lower()
        if any(mark in low for mark in ("captcha", "just a moment", "checking your browser")):
            status = "challenge"
            continue
        return "ok", text
    return status, ""


def run_available(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off what there is now in batches, then stop; a second run goes on where this one ended."""
    query = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def upsert(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends only keys that the table doesn't have yet, so a repeated batch changes nothing."""
    from quaylark.sources.writers import append_new

    return lambda batch, _: append_new(batch, path, keys) and None


def collected(rows: DataFrame, name: str, settings: dict, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read back its rows; each batch has a folder that a retry overwrites.
    The last state of each batch stands in complete mode."""
    spark = rows.sparkSession
    import uuid

    path = f"{shared_dir(spark)}/streams/out-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    run_available(rows, f"{path}-checkpoint", write, mode)
    read = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
    return read


def crawl(fetch: Callable[[int], list[dict]], seen: set[str], state: dict, old_pages: int = 3, pages: int = 1000) -> list[dict]:
    """Listing pages from where the state stands: stops on an empty page, a page that repeats the one before, after `old_pages`
    pages without anything new in a row, or at the page budget. The next page is in the state before a page is read."""
    out, streak = [], 0
    for _ in range(pages):
        page = state.get("next", 1)
        state["next"] = page + 1
        rows = fetch(page)
        mark = hashlib.sha256(json.dumps(sorted(r["url"] for r in rows)).encode()).hexdigest()
        if not rows or mark == state.get("mark"):
            break
        state["mark"] = mark
        new = [r for r in rows if r["url"] not in seen]
        seen.update(r["url"] for r in new)
        out += new
        streak = 0 if new else streak + 1
        if streak >= old_pages:
            break
    return out
