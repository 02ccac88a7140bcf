"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of `window` words is hashed (mod 2^61 - 1). A task sends, for each bucket of hash values, one packed row
with the hash of each window that is the first of its kind within the task's block of documents; later ones in the block
are repeats already, so a window that a third of all documents hold crosses the network once a block. A bucket finds the
first occurrence over all blocks and answers with the start positions of the others. Each document then merges its
repeated windows into maximal removal intervals.

Bounded memory: blocks hold FLUSH_WORDS words (or one longer text), buckets BUCKET_BYTES of text. No Spark state is kept
outside shuffles.

Windows are equal by their 61-bit hash; words are not compared. Of n different windows about n^2 / 2^62 pairs share a hash by
chance: one pair at 2 * 10^9 windows, 10^5 windows of 10^13 (100 TB), each of which may cost one document 20 words.

Null or empty texts have no words. Rows that share a doc_id (also null) count as one document and all get its result: a
window is repeated there if it starts at another place in any row of that id before; a null doc_id is smaller than any
other, and so is the smallest long, which is taken for null. Windows that start at the same place of one id are the same
window. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm import common
from quaylark.session import ship

WINDOW = 20
NULL_ID = -(1 << 63)
_SENT = "bucket int, late boolean, packed binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("late", pa.bool_()), ("packed", pa.binary())])


def _id(value) -> int:
    return NULL_ID if value is None else value


def block_windows(held: list, window: int) -> tuple:
    """Of a block, sorted by doc_id: ids, first window number of each document, all windows' hashes, and starts."""
    held = sorted(((_id(i), words) for i, words in held if len(words) >= window), key=lambda x: x[0])
    counts = np.array([len(w) for _, w in held], np.int64)
    ids = np.array([i for i, _ in held], np.int64)
    t = common.word_hashes([w for _, words in held for w in words])
    h = common.gram_hashes(t, window)
    ends = np.cumsum(counts)
    starts_of = ends - counts
    inside = np.ones(len(h), bool)
    for e in ends[:-1]:  # windows over a border between documents
        inside[e - window + 1 : e] = False
    places = np.flatnonzero(inside)
    doc = np.repeat(np.arange(len(ids)), counts - window + 1)
    return ids, doc, h[places], places - starts_of[doc]


def _send(buckets: int, window: int):
    n_bytes = max(1, -(-((1 << 61) // buckets).bit_length() // 8))

    def send(batches):
        for held in common.rows_of(batches):
            ids, doc, h, starts = block_windows(held, window)
            if not len(h):
                continue
            order = np.lexsort((starts, ids[doc], h))
            first = np.ones(len(h), bool)
            first[1:] = h[order][1:] != h[order][:-1]
            # the block's first of each window and rows with the same doc_id and start are the same window
            owner = order[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
            late = order[(ids[doc[owner]] != ids[doc[order]]) | (starts[owner] != starts[order])]
            rows = [(to, True, packed) for to, packed in pack_starts(ids[doc[late]], starts[late], buckets)]
            kept = np.sort(order[first])
            q, bucket = np.divmod(h[kept], np.uint64(buckets))
            by = np.argsort(bucket, kind="stable")
            for a, b in _runs(bucket[by]):
                at = kept[by[a:b]]
                docs = np.array([(x, y - x) for x, y in _runs(doc[at])], np.int64)
                steps = np.diff(starts[at], prepend=0)
                steps[docs[:, 0]] = starts[at[docs[:, 0]]]
                head = np.array([b - a, len(docs)], "<u4").tobytes()
                named = ids[doc[at[docs[:, 0]]]]
                rows.append((int(bucket[by[a]]), False, head + common.planes(np.diff(named, prepend=0), 8) + common.planes(docs[:, 1], 4) + common.planes(steps, 4) + common.planes(q[by[a:b]], n_bytes)))
            yield pa.RecordBatch.from_pydict({name: [r[k] for r in rows] for k, name in enumerate(_SENT_ARROW.names)}, schema=_SENT_ARROW)

    def read(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = (int(x) for x in np.frombuffer(packed, "<u4", 2))
        at = 8
        named = np.cumsum(common.unplanes(packed[at:], m, 8).astype(np.int64))
        at += 8 * m
        counts = common.unplanes(packed[at:], m, 4).astype(np.int64)
        at += 4 * m
        steps = common.unplanes(packed[at:], n, 4).astype(np.int64)
        at += 4 * n
        q = common.unplanes(packed[at:], n, n_bytes)
        total = np.cumsum(steps)
        begins = np.cumsum(counts) - counts
        starts = total - np.repeat(total[begins] - steps[begins], counts)
        return q, np.repeat(named, counts), starts

    return send, read


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]))


def pack_starts(ids: np.ndarray, starts: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Start positions of many documents, packed into one row for each part of the documents."""
    part = common.mixed(ids) % np.uint64(parts)
    order = np.lexsort((starts, ids, part))
    ids, starts, part = ids[order], starts[order], part[order]
    out = []
    for a, b in _runs(part):
        docs = np.array([(x, y - x) for x, y in _runs(ids[a:b])], np.int64)
        steps = np.diff(starts[a:b], prepend=0)
        steps[docs[:, 0]] = starts[a + docs[:, 0]]
        head = np.array([b - a, len(docs)], "<u4").tobytes()
        out.append((int(part[a]), head + common.planes(np.diff(ids[a + docs[:, 0]], prepend=0), 8) + common.planes(docs[:, 1], 4) + common.planes(steps, 4)))
    return out


def unpack_starts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(packed, "<u4", 2))
    named = np.cumsum(common.unplanes(packed[8:], m, 8).astype(np.int64))
    counts = common.unplanes(packed[8 + 8 * m :], m, 4).astype(np.int64)
    steps = common.unplanes(packed[8 + 12 * m :], n, 4).astype(np.int64)
    total, begins = np.cumsum(steps), np.cumsum(counts) - counts
    return np.repeat(named, counts), total - np.repeat(total[begins] - steps[begins], counts)


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): for each document with any, the start positions, packed, of its windows that also start earlier."""
    ship(docs.sparkSession)
    buckets = common.bucket_count(docs)
    send, read = _send(buckets, window)

    def answer(table: pa.Table) -> pa.Table:
        late_ids, late_starts, parts = [], [], []
        for late, packed in zip(table.column("late").to_pylist(), table.column("packed")):
            if late:
                ids, starts = unpack_starts(packed.as_py())
                late_ids.append(ids)
                late_starts.append(starts)
            else:
                parts.append(read(packed.as_py()))
        if parts:
            q, ids, starts = (np.concatenate(x) for x in zip(*parts))
            del parts
            order = np.lexsort((starts, ids, q))
            q, ids, starts = q[order], ids[order], starts[order]
            first = np.ones(len(q), bool)
            first[1:] = q[1:] != q[:-1]
            owner = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            late = (ids != ids[owner]) | (starts != starts[owner])
            late_ids.append(ids[late])
            late_starts.append(starts[late])
        rows = pack_starts(np.concatenate(late_ids), np.concatenate(late_starts), buckets)
        return pa.table({"to": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        ids, starts = (np.concatenate(x) for x in zip(*(unpack_starts(p.as_py()) for p in table.column("packed"))))
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order].astype("<u4")
        runs = _runs(ids)
        return pa.table({"doc_id": pa.array([int(ids[a]) for a, _ in runs], pa.int64()), "starts": pa.array([starts[a:b].tobytes() for a, b in runs], pa.binary())})

    sent = docs.select("doc_id", "text").mapInArrow(send, _SENT)
    answered = sent.groupBy("bucket").applyInArrow(answer, "to int, packed binary")
    return answered.groupBy("to").applyInArrow(gather, "doc_id long, starts binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, intervals (start, end in words, maximal, end exclusive), kept_text."""
    found = repeated_starts(docs, window).withColumnRenamed("doc_id", "key")
    joined = docs.select("doc_id", "text").join(found, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("key"), "left").select("doc_id", "text", "starts")

    def cut(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "intervals": [], "kept_text": []}
            texts, starts = batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                words = common.split_words(texts[i].as_py())
                spans, gone = [], 0
                if (packed := starts[i].as_py()) and words:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = np.frombuffer(packed, "<u4").astype(np.int64)
                    at = at[at < len(words)]
                    np.add.at(change, at, 1)
                    np.add.at(change, np.minimum(at + window, len(words)), -1)
                    covered = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))).reshape(-1, 2)
                    spans, gone = [{"start": int(a), "end": int(b)} for a, b in edges], int(covered.sum())
                kept = words
                if spans:
                    kept, last = [], 0
                    for s in spans:
                        kept += words[last : s["start"]]
                        last = s["end"]
                    kept += words[last:]
                out["n_words"].append(len(words))
                out["n_removed"].append(gone)
                out["intervals"].append(spans)
                out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [out["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["intervals"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept_text"], pa.string())],
                ["doc_id", "n_words", "n_removed", "intervals", "kept_text"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM late)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.doc_id IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
