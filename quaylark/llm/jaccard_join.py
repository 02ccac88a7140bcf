"""N-gram Jaccard join: connected components of documents whose word-shingle sets are alike, by a prefix-tree join.

1. Every document's distinct shingles (5 words, A-Z lower-cased; shorter texts: all words as one) are hashed and counted
   in buckets of hash values. A bucket answers with each document's shared shingles and their document counts. On the way
   documents go by their place (task, block of words, place in the block), whose differences fit a byte or two where those of
   ids take eight for each bucket that a document meets; ids and set sizes are sent once. Shingles that a sample finds in
   very many documents would fill their bucket: these are counted (over all documents) by task before they are shuffled, and
   go straight to their documents.
2. Sets are ordered rarest shingle first. Two sets can be alike only if their prefixes of n - ceil(t n) + 1 shingles
   meet. A set whose prefix is all its own has no partner and goes no further. Equal sets become one class.
3. Classes that meet in a prefix shingle form groups, by star edges and not by pairs. A group's sets meet in one task, are
   put into a trie in the global order, and each set walks the trie once: overlap with a path is shared by all sets below
   it, subtrees are cut where the overlap so far and the shingles that remain on either side can't reach the bound, and where
   all sets below are linked with it already. Only links that join two components are put out.
4. A group that is too much for a task is cut twice: by a hash, and by each set's rarest shared prefix shingle, so a set is
   sent twice. That links near copies. What is left are prefix shingles whose sets are still of several components: those
   sets meet, a trie for each such shingle, so a set is sent about once for each shingle of its prefix, however large the
   group. The sets of one such shingle that are of its greatest component needn't meet one another: they are cut by a hash, and
   the others go to each part; the others meet chunk by chunk.

Shingles are equal by the low 40 bits of a 61-bit hash within its bucket and the bucket's number, some 45 to 60 bits in all;
words are not compared. Two sets agree by chance on one shingle of theirs with a probability of about n * m / 2^45 at
the least, 1e-8 for two sets of 500; a link changes only if the pair is that near to the bound.

Rows are known by doc_id and text, so rows that share a doc_id (or have none) are each judged by their own text; equal rows
alike. Null or empty texts have empty sets and are linked with nothing. A component is named by the least doc_id that isn't
null in it. Very long texts are read whole, a block of words at a time at most one text more. Other columns are ignored.
Input must come in the same order if a task is run again, as files do and shuffled rows may not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm import common
from quaylark.session import ship, stored

SHINGLE = 5
#: Likeness from which two documents are linked, in hundredths.
LIKE = 80
#: Bytes of a hash within its bucket.
Q_BYTES = 5
#: Shared shingles of one task's trie; larger groups are cut.
CHUNK = 1_500_000
#: Shared shingles that are never worth a cut.
LEAST_CHUNK = 5_000
#: Documents that a bucket may hold of one shingle by far, and rows of the sample that looks for such shingles: a thousandth of
#: all within these bounds. A shingle of HOT_LEAST rows of the sample is the rarest that can be told.
HOT, HOT_LEAST, SAMPLE, MOST_SAMPLE = 10_000, 20, 20_000, 1_000_000
_HOT_MARK, _NAME_MARK = 0xFFFFFFFF, 0xFFFFFFFE
#: Bits of a document's place for the place in its block and for the block in its task.
PLACE_BITS, BLOCK_BITS = 20, 22

_SETS = "doc_id long, n long, digest binary, packed binary, prefix array<long>"


def block_sets(held: list, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, document number of each shingle, hash of each distinct shingle, ordered by document."""
    held = [(i, words) for i, words in held if words]
    ids = np.array([i for i, _ in held], np.int64)
    counts = np.array([len(w) for _, w in held], np.int64)
    t = common.word_hashes([w for _, words in held for w in words])
    ends = np.cumsum(counts)
    h = common.gram_hashes(t, shingle)
    inside = np.ones(len(h), bool)
    for e, c in zip(ends.tolist(), counts.tolist()):
        inside[max(0, e - min(c, shingle - 1)) : e] = False
    places = np.flatnonzero(inside)
    doc, value = np.searchsorted(ends, places, "right"), h[places]
    short = np.flatnonzero(counts < shingle)
    if len(short):
        whole = [common.gram_hashes(t[ends[d] - counts[d] : ends[d]], int(counts[d]))[0] ^ np.uint64(counts[d]) for d in short.tolist()]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, np.array(whole, np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return ids, doc[new], value[new]


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return begins, np.diff(np.append(begins, len(keys)))


def prefix_length(n: int, like: int) -> int:
    return n - -(-like * n // 100) + 1 if n else 0


def hot_messages(ids: np.ndarray, at: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Documents and their hot shingles (places in the list of hot ones), packed into one row for each part of the documents."""
    to = common.mixed(ids) % np.uint64(parts)
    order = np.lexsort((at, ids, to))
    ids, at, to = ids[order], at[order], to[order]
    out = []
    for a, c in zip(*(x.tolist() for x in _grouped(to))):
        head = np.array([_HOT_MARK, c], "<u4").tobytes()
        out.append((int(to[a]), head + common.planes(np.diff(ids[a : a + c], prepend=0), 8) + common.planes(at[a : a + c], 4)))
    return out


def read_hot(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    c = int(np.frombuffer(packed, "<u4", 2)[1])
    return np.cumsum(common.unplanes(packed[8:], c, 8).astype(np.int64)), common.unplanes(packed[8 + 8 * c :], c, 4).astype(np.int64)


def places(task: int, block: int, n: int) -> np.ndarray:
    """Numbers of the n documents of a task's block, unlike all others."""
    if n > 1 << PLACE_BITS or block >= 1 << BLOCK_BITS or task >= 1 << 63 - PLACE_BITS - BLOCK_BITS:
        raise ValueError(f"no place for {n} documents of block {block} of task {task}")
    return np.arange(n, dtype=np.int64) + (task << PLACE_BITS + BLOCK_BITS | block << PLACE_BITS)


def name_messages(place: np.ndarray, ids: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> list[tuple[int, bytes]]:
    """Places of documents with their ids and set sizes, packed into one row for each part of the documents. All in order of to."""
    out = []
    for a, c in zip(*(x.tolist() for x in _grouped(to))):
        head = np.array([_NAME_MARK, c], "<u4").tobytes()
        out.append((int(to[a]), head + common.planes(np.diff(place[a : a + c], prepend=0), 8) + common.planes(sizes[a : a + c], 4) + common.planes(ids[a : a + c], 8)))
    return out


def read_names(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, ids, sizes."""
    c = int(np.frombuffer(packed, "<u4", 2)[1])
    place, sizes = np.cumsum(common.unplanes(packed[8:], c, 8).astype(np.int64)), common.unplanes(packed[8 + 8 * c :], c, 4).astype(np.int64)
    return place, common.unplanes(packed[8 + 12 * c :], c, 8).astype(np.int64), sizes


def hot_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of shingles that fill their bucket, and the number of documents of each.

    A sample only decides which shingles are looked after (no result rests on it); the numbers count all documents, summed up
    by task before they are shuffled."""
    n = docs.count()
    size = min(MOST_SAMPLE, max(SAMPLE, n // 1000))
    least = max(HOT_LEAST, -(-HOT * min(size, n) // max(1, n)))
    if n < HOT:
        return np.empty(0, np.uint64), np.empty(0, np.int64)

    def often(batches):
        for held in common.rows_of(batches, common.FLUSH_WORDS // 2, lower=True):
            _, doc, h = block_sets(held, shingle)
            values, counts = np.unique(h, return_counts=True)
            kept = counts >= max(2, len(held) * least // (2 * size))
            yield pa.RecordBatch.from_arrays([pa.array(values[kept].astype(np.int64)), pa.array(counts[kept])], ["h", "n"])

    def count(batches):
        total = np.zeros(len(held_hot.value), np.int64)
        for held in common.rows_of(batches, lower=True):
            _, doc, h = block_sets(held, shingle)
            at = np.minimum(np.searchsorted(held_hot.value, h), len(total) - 1)
            total += np.bincount(at[held_hot.value[at] == h], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["h", "n"])

    summed = lambda df: df.groupBy("h").agg(F.sum("n").alias("n"))
    rows = docs.select("doc_id", "text")
    # the sample is cut by the ids' hashes alone: no task sorts or holds the texts, each looks at its own
    last = common.sampled(docs.select("doc_id"), ["doc_id"], size).agg(F.max(F.xxhash64("doc_id"))).first()[0]
    found = summed(rows.where(F.xxhash64("doc_id") <= last).mapInArrow(often, "h long, n long")).where(F.col("n") >= least)
    hot = np.sort(np.array([r.h for r in found.select("h").collect()], np.uint64))  # size * shingles of a document / least at most
    counts = np.full(len(hot), 2, np.int64)
    if len(hot):
        held_hot = docs.sparkSession.sparkContext.broadcast(hot)
        for r in summed(rows.mapInArrow(count, "h long, n long")).collect():
            counts[r.h] = max(2, r.n)
    return hot, counts


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """docs: doc_id (here any number of a row, not null) and text. doc_id, n, and for sets that may have a partner digest, packed (counts and shared shingles in global order) and
    prefix (shared shingles of the prefix)."""
    ship(docs.sparkSession)
    buckets = common.bucket_count(docs)
    hot, hot_counts = hot_shingles(docs, shingle)
    hot_tokens = (hot // np.uint64(buckets) & np.uint64((1 << 8 * Q_BYTES) - 1)).astype(np.int64) * buckets + (hot % np.uint64(buckets)).astype(np.int64)
    hot_held = docs.sparkSession.sparkContext.broadcast((hot, hot_counts, hot_tokens))  # bounded by the sample

    def send(batches):
        hot, task = hot_held.value[0], TaskContext.get().partitionId()
        for block, held in enumerate(common.rows_of(batches, lower=True)):
            # by the part of the documents where each is gathered, so that places and parts rise together
            part = common.mixed(np.array([i for i, _ in held], np.int64)) % np.uint64(buckets)
            ids, doc, h = block_sets([held[k] for k in np.argsort(part, kind="stable").tolist()], shingle)
            if not len(h):
                continue
            place, parts = places(task, block, len(ids)), (common.mixed(ids) % np.uint64(buckets)).astype(np.int64)
            rows = name_messages(place, ids, np.bincount(doc, minlength=len(ids)), parts)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                is_hot = hot[at] == h
                rows += hot_messages(ids[doc[is_hot]], at[is_hot], buckets)
                doc, h = doc[~is_hot], h[~is_hot]
            q, bucket = np.divmod(h, np.uint64(buckets))
            by = np.argsort(bucket, kind="stable")
            for a, c in zip(*(x.tolist() for x in _grouped(bucket[by]))):
                at = by[a : a + c]
                begins, lengths = _grouped(doc[at])
                who = doc[at[begins]]
                head = np.array([c, len(begins)], "<u4").tobytes() + common.planes(np.diff(place[who], prepend=0), 8) + common.planes(np.diff(parts[who], prepend=0), 4)
                rows.append((int(bucket[at[0]]), head + common.planes(lengths, 4) + common.planes(q[at], Q_BYTES)))
            yield pa.RecordBatch.from_pydict({"bucket": [r[0] for r in rows], "packed": [r[1] for r in rows]}, schema=pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))

    def count(table: pa.Table) -> pa.Table:
        here, ids, q, places_, parts, direct = table.column("bucket")[0].as_py(), [], [], [], [], []
        out = {"to": [], "packed": []}
        for packed in table.column("packed").to_pylist():
            if packed[:4] == b"\xff\xff\xff\xff":
                direct.append(read_hot(packed))
                continue
            if packed[:4] == b"\xfe\xff\xff\xff":  # of the documents that are gathered under this number
                out["to"].append(here)
                out["packed"].append(packed)
                continue
            c, m = (int(x) for x in np.frombuffer(packed, "<u4", 2))
            places_.append(np.cumsum(common.unplanes(packed[8:], m, 8).astype(np.int64)))
            parts.append(np.cumsum(common.unplanes(packed[8 + 8 * m :], m, 4).astype(np.int64)))
            ids.append(np.repeat(places_[-1], common.unplanes(packed[8 + 12 * m :], m, 4).astype(np.int64)))
            q.append(common.unplanes(packed[8 + 16 * m :], c, Q_BYTES))
        if direct:  # of these documents too; equal rows send the same
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*direct)]), axis=1)
            for to, packed in hot_messages(pairs[0], pairs[1], buckets):
                out["to"].append(to)
                out["packed"].append(packed)
        if not ids:
            return pa.table({"to": pa.array(out["to"], pa.int32()), "packed": pa.array(out["packed"], pa.binary())})
        ids, q = np.concatenate(ids), np.concatenate(q)
        order = np.lexsort((ids, q))
        ids, q = ids[order], q[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        ids, q = ids[new], q[new]
        df = np.repeat(*(lambda b, n: (n, n))(*_grouped(q)))
        ids, q, df = ids[df > 1], q[df > 1], df[df > 1]
        places_, parts = np.concatenate(places_), np.concatenate(parts)
        order = np.argsort(places_)
        to = parts[order][np.searchsorted(places_, ids, sorter=order)]
        order = np.lexsort((ids, to))
        ids, q, df, to = ids[order], q[order], df[order], to[order]
        for a, c in zip(*(x.tolist() for x in _grouped(to))):
            i, d = ids[a : a + c], df[a : a + c]
            begins, lengths = _grouped(i)
            head = np.array([here, len(begins), c], "<u4").tobytes()
            out["to"].append(int(to[a]))
            out["packed"].append(head + common.planes(np.diff(i[begins], prepend=0), 8) + common.planes(lengths, 4) + common.planes(d, 4) + common.planes(q[a : a + c], Q_BYTES))
        return pa.table({"to": pa.array(out["to"], pa.int32()), "packed": pa.array(out["packed"], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows = table.column("packed").to_pylist()
        place, ids, total = map(np.concatenate, zip(*(read_names(x) for x in rows if x[:4] == b"\xfe\xff\xff\xff")))
        order = np.lexsort((place, ids))
        first = order[_grouped(ids[order])[0]]  # equal rows have one id and several places: one will do
        wanted = np.zeros(len(ids), bool)
        wanted[first] = True
        order = np.argsort(place)
        by_place, id_of, wanted = place[order], ids[order], wanted[order]
        ids, total = ids[first], total[first]
        none = np.empty(0, np.int64)
        shared_ids, tokens, dfs = [none], [none], [none]
        for packed in rows:
            if packed[:4] == b"\xfe\xff\xff\xff":
                continue
            if packed[:4] == b"\xff\xff\xff\xff":
                i, at = read_hot(packed)
                shared_ids.append(i)
                dfs.append(hot_held.value[1][at])
                tokens.append(hot_held.value[2][at])
                continue
            here, m, s = (int(x) for x in np.frombuffer(packed, "<u4", 3))
            i = np.repeat(np.cumsum(common.unplanes(packed[12:], m, 8).astype(np.int64)), common.unplanes(packed[12 + 8 * m :], m, 4).astype(np.int64))
            d = common.unplanes(packed[12 + 12 * m :], s, 4).astype(np.int64)
            t = common.unplanes(packed[12 + 12 * m + 4 * s :], s, Q_BYTES).astype(np.int64) * buckets + here
            at = np.minimum(np.searchsorted(by_place, i), len(by_place) - 1)
            if (by_place[at] != i).any():
                raise RuntimeError("the rows came in another order when a task was run again")
            kept = wanted[at]
            shared_ids.append(id_of[at[kept]])
            dfs.append(d[kept])
            tokens.append(t[kept])
        shared_ids, tokens, dfs = map(np.concatenate, (shared_ids, tokens, dfs))
        order = np.lexsort((tokens, dfs, shared_ids))
        shared_ids, tokens, dfs = shared_ids[order], tokens[order], dfs[order]
        lo, hi = np.searchsorted(shared_ids, ids, "left"), np.searchsorted(shared_ids, ids, "right")
        digests, packs, prefixes = [], [], []
        for k, size in enumerate(total.tolist()):
            t, d = tokens[lo[k] : hi[k]], dfs[lo[k] : hi[k]]
            open_ = prefix_length(size, like) - (size - len(t))
            if open_ > 0 and len(t):
                # only sets without shingles of their own can equal another
                digests.append(xxhash.xxh3_128_digest(t.tobytes(), len(t)) if len(t) == size else b"own" + int(ids[k]).to_bytes(8, "little", signed=True))
                packs.append(common.planes(d, 4) + common.planes(t, 8))
                prefixes.append(t[:open_])
            else:
                digests.append(None)
                packs.append(None)
                prefixes.append(None)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(total, pa.int64()), "digest": pa.array(digests, pa.binary()), "packed": pa.array(packs, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    counted = docs.select("doc_id", "text").mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(count, "to int, packed binary")
    return counted.groupBy("to").applyInArrow(gather, _SETS)


class _Node:
    __slots__ = ("below", "deep", "high", "leaves", "low", "one", "own", "top")

    def __init__(self, own):
        self.own, self.below, self.leaves = own, [], []
        self.one = -1  # a set below, once all sets below are known to be linked with one another


def build_trie(sets: list[np.ndarray], sizes: list[int], members: list[int]) -> _Node:
    """A path-compressed trie of ascending rank arrays. low, high: least and largest set size below; deep: most ranks
    below a node, its own not counted; top: the node's largest rank."""
    members = sorted(members, key=lambda k: sets[k].astype(">u4").tobytes())
    root = _Node(np.empty(0, np.int64))
    path, last = [(root, 0)], np.empty(0, np.int64)  # nodes on the way to the last set, with the depth where each begins
    for k in members:
        s = sets[k]
        m = min(len(s), len(last))
        differ = np.flatnonzero(s[:m] != last[:m])
        same = int(differ[0]) if len(differ) else m
        while len(path) > 1 and path[-1][1] >= same:
            path.pop()
        node, begin = path[-1]
        if (cut := same - begin) < len(node.own):
            lower = _Node(node.own[cut:])
            lower.below, lower.leaves = node.below, node.leaves
            node.own, node.below, node.leaves = node.own[:cut], [lower], []
        if same < len(s):
            new = _Node(s[same:])
            node.below.append(new)
            path.append((new, same))
            node = new
        node.leaves.append(k)
        last = s
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.below
    for node in reversed(order):
        found = [sizes[k] for k in node.leaves]
        node.low = min([*found, *(x.low for x in node.below)], default=0)
        node.high = max([*found, *(x.high for x in node.below)], default=0)
        node.deep = max((len(x.own) + x.deep for x in node.below), default=0)
        node.top = int(node.own[-1]) if len(node.own) else -1
    return root


def links(ids: list[int], sizes: list[int], sets: list[np.ndarray], n_ranks: int, like: int, indexed: list[int], probes: list[int], known: list[int]) -> list[tuple[int, int]]:
    """Links between probes and indexed sets that join two components, by one walk of the trie for each probe. known: a number
    for each set, the same for sets that are of one component already."""
    first: dict[int, int] = {}
    parent = [first.setdefault(c, k) for k, c in enumerate(known)]

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    root, out, mark, whole = build_trie(sets, sizes, indexed), [], np.zeros(n_ranks, bool), like + 100
    for x in probes:
        s, nx = sets[x], sizes[x]
        mark[s] = True
        todo = [(root, 0, False)]
        while todo:
            node, over, after = todo.pop()
            if after:  # all below have been walked
                one = next(iter(node.leaves or [child.one for child in node.below]), -1)
                if one >= 0 and all(child.one >= 0 and find(child.one) == find(one) for child in node.below) and all(find(k) == find(one) for k in node.leaves):
                    node.one = one
                continue
            if node.one >= 0 and find(node.one) == find(x):
                continue
            if node.high * 100 < like * nx or nx * 100 < like * node.low:
                continue
            if len(node.own):
                over += int(np.count_nonzero(mark[node.own]))
            rest = min(node.deep, len(s) - int(np.searchsorted(s, node.top, "right")))
            if (over + rest) * whole < like * (nx + node.low):
                continue
            for k in node.leaves:
                if find(k) != find(x) and over * whole >= like * (nx + sizes[k]):
                    parent[find(k)] = find(x)
                    out.append((ids[x], ids[k]))
            todo.append((node, over, True))
            todo += [(child, over, False) for child in node.below]
        mark[s] = False
    return out


def piece_links(rows: list[tuple[int, int, bytes, bool, int]], like: int) -> list[tuple[int, int]]:
    """rows: id, n, packed, whether of the second chunk, component. Within one chunk: all are indexed and all probe."""
    counts = [len(r[2]) // 12 for r in rows]
    tokens = np.concatenate([common.unplanes(r[2][4 * c :], c, 8) for r, c in zip(rows, counts)])
    dfs = np.concatenate([common.unplanes(r[2], c, 4) for r, c in zip(rows, counts)])
    values, first, back = np.unique(tokens, return_index=True, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, dfs[first]))] = np.arange(len(values))
    sets = np.split(rank[back], np.cumsum(counts)[:-1])
    second = [k for k, r in enumerate(rows) if r[3]]
    indexed = [k for k, r in enumerate(rows) if not r[3]]
    return links([r[0] for r in rows], [r[1] for r in rows], sets, len(values), like, indexed, second or indexed, [r[4] for r in rows])


def links_of(placed: DataFrame, reps: DataFrame, like: int) -> DataFrame:
    """Links (a, b) of the sets of each piece. placed: id, piece (struct of by, i, j), second, component."""
    pieces = placed.join(reps.select(F.col("doc_id").alias("id"), "n", "packed"), "id")
    pieces = pieces.select(F.col("piece.by").alias("by"), F.col("piece.i").alias("i"), F.col("piece.j").alias("j"), "id", "n", "packed", "second", "component")
    pieces = pieces.repartition("by", "i", "j").sortWithinPartitions("by", "i", "j", "id")

    def join(batches):
        key, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if row[:3] != key:
                    out += piece_links(rows, like) if len(rows) > 1 else []
                    key, rows = row[:3], []
                rows.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        out = piece_links(rows, like) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return pieces.mapInArrow(join, "a long, b long")


def linked_rows(docs: DataFrame, shingle: int = SHINGLE, like: int = LIKE) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (any number that tells rows apart, not null) and text. Two tables: doc_id and n of all rows with words; id and
    component (the least id reachable) of those that are linked or equal to another."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = stored(shingle_sets(docs, shingle, like), "sets")
    open_ = sets.where("digest IS NOT NULL")
    # equal sets are one class, known by its least id
    # (sums are stored before they meet their rows again: a join of two plain tables can split a group of copies)
    classes = stored(open_.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    member = stored(open_.select("doc_id", "n", "digest").join(classes, ["digest", "n"]).select("doc_id", "rep"), "member")
    copies = member.where("doc_id <> rep").select("doc_id")
    reps = open_.join(copies, "doc_id", "left_anti")
    # (the sets themselves are not wanted here: they stay out of the join)
    prefixes = open_.select("doc_id", (F.octet_length("packed") / 12).cast("long").alias("size"), "prefix").join(copies, "doc_id", "left_anti")
    # groups that meet in a prefix shingle: star edges to the least member
    posted = stored(prefixes.select(F.col("doc_id").alias("id"), "size", F.posexplode("prefix").alias("pos", "token")), "posted")
    n_posted = posted.count()
    tokens = stored(posted.groupBy("token").agg(F.min("id").alias("m"), F.count("*").alias("c"), F.sum("size").alias("load")).where("c > 1"), "tokens")
    shared = stored(common.met(posted, tokens, "token", n_posted), "shared")
    groups = stored(common.components(shared.where("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b")).distinct()).withColumnRenamed("component", "by"), "groups")
    sized = stored(groups.join(shared.groupBy("id").agg(F.first("size").alias("size"), F.min(F.struct("pos", "token", "load")).alias("rare")), "id"), "sized")
    chunks = stored(sized.groupBy("by").agg(F.sum("size").alias("load")), "chunks")
    # a group that stands out among the tasks is cut, and what a task can't hold always is
    bound = min(CHUNK, max(LEAST_CHUNK, 4 * (chunks.agg(F.sum("load")).first()[0] or 0) // partitions))
    chunks = stored(chunks.select("by", F.ceil(F.col("load") / bound).cast("int").alias("k")), "cuts")
    placed = common.met(sized, chunks, "by", sized.count())
    part = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    alone = lambda by, c: F.struct(by.alias("by"), c.alias("i"), c.alias("j")).alias("piece")
    rare = F.greatest(F.lit(1), F.ceil(F.col("rare.load") / bound)).cast("int")
    ones = placed.select("id", alone(F.col("by"), part(F.col("k"))), F.lit(False).alias("second"), F.col("id").alias("component"))
    twos = placed.where("k > 1").select("id", alone(F.xxhash64(F.lit("rare"), "rare.token"), part(rare)), F.lit(False).alias("second"), F.col("id").alias("component"))
    found = stored(links_of(ones.unionByName(twos), reps, like), "links")
    linked = stored(common.components(found), "linked")
    cut = placed.where("k > 1").select("id")
    if not cut.isEmpty():
        # prefix shingles of cut groups whose sets are still of several components
        mine = shared.join(cut, "id").select("id", "size", "token").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mine = stored(mine, "mine")
        # of each, the component with the most sets and the others: sets of one component needn't meet, so those of the greatest
        # are dealt to chunks and the others go to each of these; the others meet among themselves, chunk by chunk
        share = mine.groupBy("token", "component").agg(F.count("*").alias("c"), F.sum("size").alias("load"))
        share = share.groupBy("token").agg(F.max(F.struct("c", "component", "load")).alias("most"), F.sum("load").alias("load"), F.count("*").alias("kinds")).where("kinds > 1")
        cuts = lambda load, size: F.greatest(F.lit(1), F.ceil(load / size)).cast("int")
        still = stored(share.select("token", F.col("most.component").alias("main"), cuts(F.col("most.load"), bound).alias("k"), cuts(F.col("load") - F.col("most.load"), CHUNK).alias("k2")), "still")
        more = common.met(mine, still, "token", n_posted).withColumn("other", F.col("component") != F.col("main"))
        to = F.when(F.col("other"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(part(F.col("k"))))
        mains = more.withColumn("c", F.explode(to)).select("id", F.struct(F.col("token").alias("by"), F.col("c").alias("i"), F.lit(-1).alias("j")).alias("piece"), F.col("other").alias("second"), "component")
        rest = more.where("other").withColumn("c", part(F.col("k2"))).withColumn("c2", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
        piece = F.struct(F.xxhash64(F.lit("rest"), "token").alias("by"), F.least("c", "c2").alias("i"), F.greatest("c", "c2").alias("j")).alias("piece")
        rest = rest.select("id", piece, (F.col("c") > F.col("c2")).alias("second"), "component")
        found = found.unionByName(stored(links_of(mains.unionByName(rest), reps, like), "links"))
        linked = stored(common.components(found), "linked")
    # copies follow their representative
    told = member.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component"))
    return sets.select("doc_id", "n"), linked.join(told, "id", "left_anti").unionByName(told)


def similar_components(docs: DataFrame, shingle: int = SHINGLE, like: int = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "text")
    sizes, linked = linked_rows(keyed.select(F.col("_key").alias("doc_id"), "text"), shingle, like)
    linked = stored(linked, "classes")
    # components are named by their least doc_id
    named = stored(keyed.select("doc_id", F.col("_key").alias("id")).join(linked, "id").groupBy("component").agg(F.min("doc_id").alias("top")), "named")
    tops = common.met(linked, named, "component", linked.count()).select(F.col("id").alias("_key"), F.lit(True).alias("_in"), "top")
    out = keyed.select("doc_id", "_key").join(sizes.withColumnRenamed("doc_id", "_key"), "_key", "left").join(tops, "_key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("_in"), F.col("top")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, t FROM (
  SELECT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS s FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, e.y FROM reach JOIN e ON e.x = reach.r)
SELECT reach.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.doc_id GROUP BY 1
"""
