"""Pieces that several operators share: word hashing, byte packing, bucket counts, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quaylark.session import stored

#: Modulus of the polynomial hashes, a Mersenne prime.
P61 = np.uint64((1 << 61) - 1)
#: Words worked on at once; bounds a worker's memory.
FLUSH_WORDS = 600_000
#: Bytes of text that one bucket of hashes stands for, so that a bucket fits a worker at any input size.
BUCKET_BYTES = 16 << 20
#: Rows of one key that a task joins in any case.
HUB = 256


def mulmod(a: np.ndarray, b: int) -> np.ndarray:
    """a * b mod 2^61 - 1, elementwise, for a < 2^61."""
    m31, m30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al = a >> np.uint64(31), a & m31
    bh, bl = np.uint64(b >> 31), np.uint64(b & ((1 << 31) - 1))
    mid = ah * bl + al * bh
    low = al * bl
    total = ((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & m30) << np.uint64(31)) + (low & P61) + (low >> np.uint64(61))
    total = (total & P61) + (total >> np.uint64(61))
    return np.where(total >= P61, total - P61, total)


def addmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    return np.where(total >= P61, total - P61, total)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words without white space x20 and x09 to x0D, as UTF-8; lower: A-Z become a-z, nothing else changes."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    found = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return found % P61


def gram_hashes(t: np.ndarray, n: int, base: int = 0x1F3D5B79A8C64E21 % ((1 << 61) - 1)) -> np.ndarray:
    """Rabin-Karp hashes of all runs of n values: sum of t[i+j] * base^(n-1-j) mod 2^61 - 1, put together from runs of powers of two."""
    p = int(P61)
    if len(t) < n:
        return np.empty(0, np.uint64)
    out, out_len, part, part_len, rest = None, 0, t, 1, n
    while rest:
        if rest & 1:
            if out is None:
                out, out_len = part, part_len
            else:
                m = len(t) - (out_len + part_len) + 1
                out, out_len = addmod(mulmod(out[:m], pow(base, part_len, p)), part[out_len : out_len + m]), out_len + part_len
        rest >>= 1
        if rest:
            m = len(t) - 2 * part_len + 1
            part, part_len = addmod(mulmod(part[:m], pow(base, part_len, p)), part[part_len : part_len + m]), 2 * part_len
    return out


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The low n_bytes of each value, all first bytes first: planes of zeros then compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def unplanes(data: bytes, count: int, n_bytes: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(data, np.uint8, count * n_bytes).reshape(n_bytes, count).T
    return out.view("<u8").reshape(-1)


def rows_of(batches, flush: int = FLUSH_WORDS, lower: bool = False):
    """Lists of (doc_id, words) of about flush words from Arrow batches of doc_id and text."""
    held, n = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            words = split_words(texts[i].as_py(), lower)
            held.append((ids[i].as_py(), words))
            n += len(words) + 1
            if n >= flush:
                yield held
                held, n = [], 0
    if held:
        yield held


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets for hashes: as many as shuffle partitions, and more where the text of one would be too much for a worker."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))


def met(left: DataFrame, right: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """left joined by key with right, which has one row a key, where some keys may have many of left's n rows.

    Keys with more than twice a task's share of the rows are few (half the shuffle partitions at most): their rows stay where
    they are and meet a broadcast, the others are shuffled."""
    most = max(HUB, 2 * n // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hubs = F.broadcast(left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key))
    rest = left.join(hubs, key, "left_anti").join(right, key, how)
    return rest.unionByName(left.join(hubs, key, "left_semi").join(F.broadcast(right.join(hubs, key, "left_semi")), key, how))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for the ids of edges (a, b): the smallest id reachable.

    In each round every node's edges to smaller neighbours move to the smallest of them, then every node points at its parent's
    parent. Neighbours are summed up by a minimum before they are shuffled, rows of hubs meet a broadcast, and each round is
    written to the shared folder."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        n = now.count()
        linked = met(now, now.groupBy("a").agg(F.min("b").alias("m")), "a", n)
        moved = stored(linked.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct(), "moved")
        parent = moved.groupBy("a").agg(F.min("b").alias("b"))
        jumped = met(moved, parent.select(F.col("a").alias("b"), F.col("b").alias("top")), "b", n, "left").select("a", F.coalesce("top", "b").alias("b"))
        kept = met(moved, parent.withColumnRenamed("b", "m"), "a", n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(jumped.unionByName(kept).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        # done when each id has one parent and no parent has one
        ends = after.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(after.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").limit(1).count()
        now = after
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def sampled(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most `most` rows: those with the least hash of the columns `by`; all rows where there are no more."""
    n, h = rows.count(), F.xxhash64(*by)
    if n > 4 * most:
        rows = rows.where(F.pmod(h, F.lit(1 << 30)) < int(2 * most / n * (1 << 30)))
    return rows.orderBy(h, *by).limit(most)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Ids spread over 64 bits, so that ids with a common stride don't meet in one part."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
