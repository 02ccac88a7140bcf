"""Document fingerprints by winnowing, with DataFrame operations only.

A text's tokens are its runs of signs that are not white space, cut after 16 signs. Rolling hashes of K tokens (a cyclic
polynomial: hashes of tokens, rotated by their place and put together by exclusive or) are made for every position, and of
every W hashes in a row the least is selected, the rightmost of equal ones. Hash and position are kept: two texts that share
K + W - 1 tokens in a row share a fingerprint, found at the kept positions.

A selected hash and its position are one long: HASH bits of hash, then PLACES bits that fall with the position, so the least
long of a window is the rightmost least hash. 2^PLACES tokens are more than a text of 130 MB can have; beyond them positions
begin again at 0.

Null texts count as empty; a text without tokens has an empty fingerprint, one with fewer than K tokens has one hash of
all its tokens. Likeness is the share of common hashes in all (1 for two empty fingerprints). Texts are read whole, at any
length. Rows are ordered by doc_id, a hash of the text and, for equal rows, their place in the table; rows with a null doc_id
come last. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 4
W = 8
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
HASH, PLACES = 36, 27
#: Documents of one group of neighbours, groups at most (their heads are broadcast: 40 bytes each), rows of a sample for each
#: border between groups, and borders that are looked at in one step.
GROUP, GROUPS, SAMPLES, STEP = 4000, 20_000, 32, 64


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _shifted(name: str, by: int) -> Column:
    return F.slice(F.col(name), F.lit(by + 1), F.greatest(F.size(name), F.lit(1)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array of selected hash and position as longs, in order of position."""
    t, g, zero = f"_{out}_t", f"_{out}_g", F.lit(0).cast("long")
    df = df.withColumn(t, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    # K = 4 hashes in two steps: pairs, then pairs of pairs
    df = df.withColumn(g, F.zip_with(F.col(t), _shifted(t, 1), lambda a, b: F.coalesce(a, zero).bitwiseXOR(_rotated(F.coalesce(b, zero), 1))))
    df = df.withColumn(g, F.zip_with(F.col(g), _shifted(g, 2), lambda a, b: F.coalesce(a, zero).bitwiseXOR(_rotated(F.coalesce(b, zero), 2))))
    low = F.lit((1 << HASH) - 1)
    place = lambda i: F.lit((1 << PLACES) - 1) - (i % (1 << PLACES))
    count = F.when(F.size(t) > 0, F.greatest(F.size(t) - (K - 1), F.lit(1))).otherwise(0)
    df = df.withColumn(g, F.transform(F.slice(F.col(g), F.lit(1), count), lambda x, i: F.shiftleft(x.bitwiseAND(low), PLACES).bitwiseOR(place(i).cast("long"))))
    # least of W = 8 in three steps
    df = df.withColumn(t, F.size(g))
    for by in (1, 2, 4):
        df = df.withColumn(g, F.zip_with(F.col(g), _shifted(g, by), lambda a, b: F.least(a, b)))
    windows = F.when(F.col(t) > 0, F.greatest(F.col(t) - (W - 1), F.lit(1))).otherwise(0)
    return df.withColumn(out, F.array_distinct(F.slice(F.col(g), F.lit(1), windows))).drop(t, g)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, PLACES)))


def positions(fingerprint: str) -> Column:
    """Hash and position of a fingerprint's entries."""
    return F.transform(fingerprint, lambda x: F.struct(F.shiftrightunsigned(x, PLACES).alias("hash"), (F.lit((1 << PLACES) - 1) - x.bitwiseAND(F.lit((1 << PLACES) - 1))).alias("pos")))


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _borders(keys: DataFrame, n: int) -> list:
    """Keys (known, k, h, s) that cut the rows into groups of about GROUP rows, in order: quantiles of a sample, whose size is
    bounded by SAMPLES * GROUPS. Where one key fills more than a group, borders differ in s only."""
    groups = min(GROUPS, -(-n // GROUP))
    if groups < 2:
        return []
    share = int(min(1.0, SAMPLES * groups / n) * (1 << 30))
    drawn = keys.where(F.pmod(F.xxhash64("known", "k", "h", "s", F.lit(7)), F.lit(1 << 30)) < share)
    found = sorted(tuple(r) for r in drawn.select("known", "k", "h", "s").collect())
    every = max(1, len(found) // groups)
    return sorted(set(found[every::every]))


def _place(borders: list) -> Column:
    """The number of borders up to the row's key: first among every STEP-th, then among the STEP that follow."""
    if not borders:
        return F.lit(0)

    def table(rows: list) -> Column:
        columns = [F.split(F.lit(",".join(str(r[c]) for r in rows)), ",").cast("array<bigint>").alias(name) for c, name in enumerate(("known", "k", "h", "s"))]
        return F.arrays_zip(*columns)

    upto = lambda some, x: F.size(F.filter(some, lambda b: b <= x))
    first = F.lit(0) if len(borders) < STEP else STEP * F.transform(F.array("key"), lambda x: upto(table(borders[STEP - 1 :: STEP]), x))[0]
    # the key and the step are bound by lambdas, so that each is worked out once a row
    return F.transform(F.array(F.struct(F.col("key").alias("x"), first.alias("i"))), lambda y: y["i"] + upto(F.slice(table(borders), y["i"] + 1, F.lit(STEP)), y["x"]))[0]


def with_next(docs: DataFrame, made, key: str = "doc_id") -> DataFrame:
    """docs (key and text) with the columns that made(df) adds, and next_<c> for each column but key: the values of the next row
    in descending order of key, after the last the first.

    Rows are dealt into groups of neighbouring keys by quantiles of the keys (key, hash of the text and, only where one such
    key fills a group, place in the table), so neither ids far from the rest nor many equal ones make a large group. Each group
    also gets the first row of the group below it, so the next row is found within a group, by one shuffle. key is an integer."""
    known, k, h = F.col(key).isNotNull().cast("long"), F.coalesce(F.col(key).cast("long"), F.lit(0)), F.xxhash64("text")
    keys = docs.select(known.alias("known"), k.alias("k"), h.alias("h"))
    n = docs.count()
    borders = _borders(keys.withColumn("s", F.lit(0).cast("long")), n)
    spread = F.lit(0).cast("long")
    if len(borders) < min(GROUPS, -(-n // GROUP)) // 2:  # borders fell together: one key fills groups
        spread = F.xxhash64(F.monotonically_increasing_id())
        borders = _borders(keys.withColumn("s", spread), n)
    dealt = docs.select(key, "text", known.alias("known"), k.alias("k"), h.alias("h"), spread.alias("s"))
    dealt = dealt.select(key, "text", F.struct("known", "k", "h", "s").alias("key")).withColumn("_g", _place(borders).cast("int"))
    heads = dealt.groupBy("_g").agg(F.max("key").alias("top"))
    one = Window.partitionBy(F.lit(0))  # of a row for each group
    heads = heads.select("top", F.coalesce(F.lead("_g").over(one.orderBy("_g")), F.min("_g").over(one)).alias("_to"))
    # a group's first row is also sent to the group above it, where it stands last; equal rows are as good as each other
    told = docs.select(key, "text", known.alias("known"), k.alias("k"), h.alias("h"))
    told = told.join(F.broadcast(heads.select(*(F.col(f"top.{c}").alias(c) for c in ("known", "k", "h"))).distinct()), ["known", "k", "h"])
    told = told.groupBy("known", "k", "h").agg(F.min("text").alias("text"), F.min(key).alias(key))
    told = told.join(F.broadcast(heads.select(*(F.col(f"top.{c}").alias(c) for c in ("known", "k", "h")), "_to")), ["known", "k", "h"])
    told = told.select(key, "text", F.struct("known", "k", "h", F.lit(0).cast("long").alias("s")).alias("key"), F.col("_to").alias("_g"), F.lit(1).alias("_last"))
    rows = made(dealt.withColumn("_last", F.lit(0)).unionByName(told))
    kept = [c for c in rows.columns if c not in ("key", "_g", "_last")]
    order = Window.partitionBy("_g").orderBy("_last", F.col("key").desc())
    led = rows.select(*kept, "_last", *(F.lead(c).over(order).alias(f"next_{c}") for c in kept if c != key))
    return led.where("_last = 0").drop("_last")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited (the text with its last half replaced by the next document's beginning), fingerprint,
    edited_fingerprint, near_edited, near_next."""
    met = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda df: with_fingerprint(df, "text", "fingerprint"))
    met = met.withColumn("n_chars", F.length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    first = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_half"))
    met = met.withColumn("edited", F.concat(first, F.substring("next_text", F.lit(1), F.col("_half")))).drop("next_text", "_half")
    met = with_fingerprint(met, "edited", "edited_fingerprint")
    met = met.withColumns({"_a": hashes("fingerprint"), "_b": hashes("edited_fingerprint"), "_c": hashes("next_fingerprint")})
    return met.select("doc_id", "text", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness("_a", "_b").alias("near_edited"), likeness("_a", "_c").alias("near_next"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.hex(x))), " ")
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), said("fingerprint").alias("fingerprint"), said("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
