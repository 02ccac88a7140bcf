"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

Words are lower-cased for A-Z and cut at all other ASCII signs but digits. An item's windows are its runs of 13 words, or the
whole item where it is shorter. A document contains a window when the window's words occur in it one after another.

1. Word shingles (5 words; all words of a shorter item) of all documents are met with those of the benchmark; the hits and
   their positions are kept. Their counts over the whole corpus order the shingles by rarity.
2. A window is contained only where all its shingles are, so one token, its rarest shingle, is the necessary prefix. Windows
   with a shingle that no document has are out.
3. A hit of a window's token at position p proposes the window at p less the token's offset. Proposals before the first or
   past the last word (length and position bounds) are out; the rest are compared word by word.

Windows are held once, however many items have them; the items of a document's windows are looked up after its windows have
been verified. What meets the documents (the shingles, the tokens with their windows' words, the windows with their items) is
broadcast while its measured size is at most BROADCAST_BYTES, and joined by a shuffle else.

Null texts have no words. Items without words have no windows. Documents are known by doc_id and a hash of their text: rows
that share a doc_id (also null) are each judged on their own words, equal rows alike. Items with a null item_id count as hits but
aren't named; repeated items are named once. Equal counts: the token is the shingle with the least hash, then the first. Texts
are read whole, at any length. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.session import stored

WINDOW = 13
SHINGLE = 5
#: A document is contaminated when hits are at least one word in SHARE.
SHARE = 20
#: Bytes that a broadcast may have, and those of a row beside its texts.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a column; lower() is used where it can only change A-Z."""
    col = F.coalesce(F.col(text), F.lit(""))
    low = F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def shingles(of: str, size: int) -> Column:
    """Hashes of the runs of `size` words of an array column, in order."""
    last = F.size(of) - size
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(size), *(F.get(F.col(of), i + j) for j in range(size))))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words (of a window, with a space between) and k, their number; one row for each window of an item."""
    cut = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0).distinct()
    cut = cut.withColumn("k", F.least(F.lit(window), F.size("w")))
    rows = cut.select("item_id", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("at"))
    return rows.select("item_id", "k", F.array_join(F.slice("w", F.col("at") + 1, F.col("k")), " ").alias("words")).distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """words, k and one row for each shingle of a window: size, off, h."""
    cut = windows.select("words", "k").distinct().withColumns({"w": F.split("words", " "), "size": F.least(F.lit(shingle), F.col("k"))})
    by_size = F.coalesce(*(F.when(F.col("size") == s, shingles("w", s)) for s in range(1, shingle + 1)))
    return cut.select("words", "k", "size", F.posexplode(by_size).alias("off", "h"))


def held(df: DataFrame, text: str | None = None) -> DataFrame:
    """df, to be broadcast if it is small enough; its rows are of ROW_BYTES and the bytes of the column `text`."""
    size = df.agg(F.sum(F.lit(ROW_BYTES) + (F.octet_length(text) if text else 0))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, carry: list[str] | None = None, named: bool = True) -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_hit, hits (start, k, words), the columns named in carry and, if named, items
    (ids of items with windows in it)."""
    carry = carry or []
    windows = stored(benchmark_windows(items, window), "windows")
    base = stored(window_shingles(windows, shingle), "shingles")
    sizes = sorted(r["size"] for r in base.select("size").distinct().collect())  # `shingle` rows at most
    row = ["doc_id", F.xxhash64("text").alias("_t")]
    cut = docs.select(*row, words("text").alias("w"))
    if len(sizes) == 1:
        mine = cut.select("doc_id", "_t", F.posexplode(shingles("w", sizes[0])).alias("pos", "h"))
    else:
        every = [F.transform(shingles("w", s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes]
        every = F.concat(*every) if every else F.array().cast("array<struct<pos:int,h:bigint>>")
        mine = cut.select("doc_id", "_t", F.explode(every).alias("x")).select("doc_id", "_t", "x.pos", "x.h")
    found = stored(mine.join(held(base.select("h").distinct()), "h").select("doc_id", "_t", "pos", "h"), "hits")
    # the corpus count of each shingle orders them; a window without one of its shingles in any document is out
    counts = found.groupBy("h").agg(F.count("*").alias("n"))
    rated = base.join(counts, "h", "left")
    tokens = rated.groupBy("words", "k").agg(F.min(F.struct("n", "h", "off")).alias("token"), F.count("n").alias("with"), F.count("*").alias("all"))
    tokens = stored(tokens.where(F.col("with") == F.col("all")).select(F.col("token.h").alias("h"), F.col("token.off").alias("off"), "words", "k"), "tokens")
    proposed = found.join(held(tokens, "words"), "h").where("pos >= off")
    proposed = proposed.select("doc_id", "_t", F.struct((F.col("pos") - F.col("off")).alias("start"), "k", "words").alias("c"))
    proposed = proposed.groupBy(F.col("doc_id").alias("key"), "_t").agg(F.sort_array(F.collect_set("c")).alias("c"))
    mine = docs.select(*dict.fromkeys(["doc_id", "text", *carry])).withColumn("_t", row[1])
    met = mine.join(proposed, F.col("doc_id").eqNullSafe(F.col("key")) & (mine["_t"] == proposed["_t"]), "left").select("doc_id", mine["_t"], *carry, words("text").alias("w"), "c")
    right = F.filter("c", lambda c: (c["start"] + c["k"] <= F.size("w")) & (F.array_join(F.slice(F.col("w"), c["start"] + 1, c["k"]), " ") == c["words"]))
    empty = F.array().cast("array<struct<start:int,k:int,words:string>>")
    done = met.select("doc_id", "_t", *carry, F.size("w").cast("long").alias("n_words"), F.coalesce(right, empty).alias("hits"))
    # hits are in order of their starts: words covered = what each adds past the end of those before
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "hits",
        nothing,
        lambda a, c: F.struct(F.greatest(a["end"], c["start"] + c["k"]).alias("end"), (a["n"] + F.greatest(F.lit(0), c["start"] + c["k"] - F.greatest(a["end"], c["start"]))).alias("n")),
        lambda a: a["n"],
    )
    done = done.select("doc_id", "_t", *carry, "n_words", covered.alias("n_hit"), "hits")
    if not named:
        return done.drop("_t")
    done = stored(done, "verified")
    ids = done.select(F.col("doc_id").alias("key"), "_t", F.explode(F.array_distinct("hits.words")).alias("words")).distinct()
    ids = ids.join(held(windows.where("item_id IS NOT NULL").select("words", "item_id"), "words"), "words").groupBy("key", "_t").agg(F.collect_set("item_id").alias("items"))
    none = F.array().cast(f"array<{dict(items.dtypes)['item_id']}>")
    out = done.join(ids, F.col("doc_id").eqNullSafe(F.col("key")) & (done["_t"] == ids["_t"]), "left")
    return out.select("doc_id", *carry, "n_words", "n_hit", "hits", F.coalesce("items", none).alias("items"))


def contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS t
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)
), hit AS (SELECT dw.doc_id, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.t = bw.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, coalesce(ids.h, sha256('')) AS items_sha256,
  coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""
