"""Labelling by a model: one request for each content and target set, cached answers, validation, fan-out to rows.

The model is a function that takes a prompt and gives JSON text; offline a rule stands for it. Answers are kept by the digest
of the request, so a resumed run asks nothing twice."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.functions import text as X
from quaylark.session import ship

ANSWER = "event_type string, score double, size string, confidence double, reason string"


def requests(rows: DataFrame, key: str, text: str, target: str, most: int | None = 12000) -> DataFrame:
    """request, said, targets, keys: rows of equal whole text are one request with the union of their targets. said, what the
    model is shown, is the text without its middle where it is longer than `most`; None: the whole text."""
    whole = F.col(text)
    grouped = rows.groupBy(whole.alias("_whole")).agg(F.array_sort(F.collect_set(target)).alias("targets"), F.array_sort(F.collect_list(key)).alias("keys"))
    said = F.col("_whole") if most is None else X.middle_cut(F.col("_whole"), most, most * 3 // 4)
    return grouped.select(said.alias("said"), "targets", "keys", F.sha2(F.to_json(F.struct(F.col("_whole").alias("said"), "targets")), 256).alias("request"))


def prompt(said: str, targets: list[str], wrong: str | None = None) -> str:
    """The question, with what was wrong with the last answer."""
    ask = f"Targets: {', '.join(targets) or 'none'}\nAnswer with one JSON object: event_type, score (-2 to 2), size, confidence (0 to 1), reason.\n\n{said}"
    return ask + (f"\n\nThe last answer was refused: {wrong}" if wrong else "")


def fault(answer: dict, kinds: list[str]) -> str | None:
    """What is wrong with an answer; None if nothing is."""
    if not isinstance(answer, dict):
        return "not an object"
    if extra := set(answer) - {"event_type", "score", "size", "confidence", "reason"}:
        return f"unknown fields {sorted(extra)}"
    if answer.get("event_type") not in kinds:
        return "event_type isn't one of the list"
    score, confidence = answer.get("score"), answer.get("confidence")
    if not isinstance(score, (int, float)) or isinstance(score, bool) or not -2 <= score <= 2:
        return "score isn't from -2 to 2"
    if not isinstance(confidence, (int, float)) or isinstance(confidence, bool) or not 0 <= confidence <= 1:
        return "confidence isn't from 0 to 1"
    if abs(score) == 2 and answer.get("size") != "large":
        return "a score of 2 needs the size large"
    return None if isinstance(answer.get("reason"), str) and answer["reason"].strip() else "no reason"


def ask(todo: DataFrame, model: Callable[[str], str], kinds: list[str], tries: int = 3) -> DataFrame:
    """request, answer, error, tries: each request is asked until an answer is right, `tries` times at most."""
    ship(todo.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                wrong, said = None, None
                for n in range(1, tries + 1):
                    try:
                        said = json.loads(model(prompt(r.said, list(r.targets), wrong)))
                        wrong = fault(said, kinds)
                    except ValueError as e:
                        wrong = f"not JSON: {e}"
                    if wrong is None:
                        break
                out.append((r.request, json.dumps(said) if wrong is None else None, wrong, n))
            yield pd.DataFrame(out, columns=["request", "answer", "error", "tries"])

    return todo.select("request", "said", "targets").mapInPandas(run, "request string, answer string, error string, tries int")


def unanswered(todo: DataFrame, cache: DataFrame) -> DataFrame:
    return todo.join(cache.where("answer IS NOT NULL").select("request"), "request", "left_anti")


def fan_out(todo: DataFrame, answers: DataFrame) -> DataFrame:
    """key, label fields: each row of a request gets its answer."""
    parsed = answers.where("answer IS NOT NULL").select("request", F.from_json("answer", ANSWER).alias("a"))
    return todo.select("request", F.explode("keys").alias("key"), X.scope(F.col("targets")).alias("scope")).join(parsed, "request").select("key", "scope", "a.*")


def valid(kinds: list[str]) -> Column:
    """The rules of a right label as a predicate over event_type, score, size, confidence, reason."""
    rules = F.col("event_type").isin(kinds) & F.col("score").between(-2, 2) & F.col("confidence").between(0, 1) & ((F.abs("score") != 2) | (F.col("size") == "large")) & (F.trim("reason") != "")
    return F.coalesce(rules, F.lit(False))


def encode(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key, vec: unit vectors of texts by a model that takes a list of texts."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in model([t or "" for t in pdf[text]]):
                n = sum(x * x for x in v) ** 0.5 or 1.0
                out.append([x / n for x in v])
            yield pd.DataFrame({key: pdf[key], "vec": out})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vec array<float>")
