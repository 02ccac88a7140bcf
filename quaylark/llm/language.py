"""Language identification by bit-sliced Bloom filters of n-grams.

One table serves all languages: slot s holds a bit mask (a word for each 64 languages) of the languages one of whose n-grams hashes to s. A lookup takes
the masks of an n-gram's slots and keeps the bits common to all, so it returns every language that contains the n-gram at
once. A text's n-grams give a popcount for each language, from which the language's own rate of false positives is
taken away; the largest share of n-grams decides.

Training reads a bounded sample: at most SAMPLE labelled documents of each language, those with the least hash of doc_id and
text (equal rows are one), so that a language never vanishes behind others, nor behind a group of copies. An n-gram belongs to a language when its
rate there is at least KEEP of its highest rate in any language, so that n-grams that merely stray into a language don't blur it.

Texts are lower-cased; everything but letters and their marks counts as a space; n-grams are of bytes within words with one
space on either side. Texts are read whole, a piece at a time. Null texts and texts without a letter (digits, superscripts,
fractions and signs are none) are `und` with score 0. Ties go to the language first in order. Rows are
independent; a table without labelled rows predicts `und` throughout. Other columns pass through unless their names
clash with the result's, which win.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.session import ship

#: Labelled documents of each language that its filter is fitted on.
SAMPLE = 1000
SIZES = (2, 3, 4)
SLOT_BITS = 20
PROBES = 3
KEEP = 0.25
LEAST_COUNT = 3
UNKNOWN = "und"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Bytes of a lower-cased text: ASCII letters and all bytes beyond ASCII stay, the rest is a space.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTER, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}\x00-\x7F]+")
_PIECE = 1 << 20


def grams(data: bytes) -> np.ndarray:
    """Codes of all n-grams of normal bytes, n in the lowest byte."""
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    out, code = [], b
    for n in range(2, max(SIZES) + 1):
        code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
        if n in SIZES:
            out.append((code << np.uint64(8)) | np.uint64(n))
    return np.concatenate(out)


def normal(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "


def pieces(data: bytes):
    """data in parts that share max(SIZES) - 1 bytes, so that long texts are read whole in bounded memory."""
    for at in range(0, max(1, len(data) - 1), _PIECE):
        yield data[at : at + _PIECE + max(SIZES) - 1]


def counted(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and their counts, summed up a few million at a time."""
    codes, n, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add() -> tuple[np.ndarray, np.ndarray]:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        every, at = np.unique(np.concatenate((codes, found)), return_inverse=True)
        return every, np.bincount(at, np.concatenate((n, times)), len(every)).astype(np.int64)

    for text in texts:
        for piece in pieces(text):
            held.append(grams(piece))
            size += len(held[-1])
            if size > 2_000_000:
                codes, n = add()
                held, size = [], 0
    return add() if held else (codes, n)


def slots(codes: np.ndarray) -> list[np.ndarray]:
    mixed = codes * _ODD[0]
    mixed ^= mixed >> np.uint64(29)
    return [(mixed * odd) >> np.uint64(64 - SLOT_BITS) for odd in _ODD[:PROBES]]


class Filters:
    """The bit-sliced table, the languages of its bits, and each language's rate of false positives."""

    def __init__(self, langs: list[str], table: np.ndarray, false: np.ndarray):
        self.langs, self.table, self.false = langs, table, false

    @classmethod
    def fit(cls, rows) -> Filters:
        """From (text, language) rows; rows in order of their language are read one at a time."""
        langs, counts = [], []
        for lang, mine in groupby(sorted(rows, key=lambda r: r[1]) if isinstance(rows, list) else rows, key=lambda r: r[1]):
            codes, n = counted(normal(text) for text, _ in mine)
            langs.append(lang)
            counts.append((codes, n, max(1, int(n.sum()))))
        every = np.unique(np.concatenate([c for c, _, _ in counts])) if counts else np.empty(0, np.uint64)
        top = np.zeros(len(every))
        for codes, n, total in counts:
            at = np.searchsorted(every, codes)
            top[at] = np.maximum(top[at], n / total)
        table, false = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), np.uint64), np.zeros(len(langs))
        for k, (codes, n, total) in enumerate(counts):
            mine, word = codes[(n >= LEAST_COUNT) & (n / total >= KEEP * top[np.searchsorted(every, codes)])], table[k // 64]
            for s in slots(mine):
                np.bitwise_or.at(word, s.astype(np.int64), np.uint64(1 << k % 64))
            false[k] = ((word >> np.uint64(k % 64)) & np.uint64(1)).mean() ** PROBES
        return cls(langs, table, false)

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits; word w has the languages from 64 w on."""
        return self._met(slots(codes), word)

    def _met(self, places: list[np.ndarray], word: int) -> np.ndarray:
        first, *rest = places
        out = self.table[word][first.astype(np.int64)]
        for s in rest:
            out &= self.table[word][s.astype(np.int64)]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of all languages' evidence."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of all languages' evidence, and its evidence: the share of the text's n-grams that it has,
        corrected for false positives. 0: no language has any of them, and the first in order is a mere guess."""
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        n, hits = 0, np.zeros(len(self.langs))
        for piece in pieces(normal(text)):
            places = slots(grams(piece))
            n += len(places[0])
            for word in range(len(self.table)):
                found, at = self._met(places, word), 64 * word
                if len(self.langs) <= 8:
                    hits += (np.bincount(found.astype(np.uint8), minlength=256) @ _BITS)[: len(self.langs)]
                else:
                    hits[at : at + 64] += [np.count_nonzero(found & np.uint64(1 << k)) for k in range(min(64, len(self.langs) - at))]
        share = np.clip((hits - n * self.false) / (1 - np.minimum(self.false, 0.99)), 0, None) / max(1, n)
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum()) if share.sum() else 1 / len(self.langs), float(share[best])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filters:
    """Filters from at most `sample` rows of each language of labelled that have text and lang."""
    by = ["doc_id"] if "doc_id" in labelled.columns else []
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(*by, text).alias("h"))

    def upto(bars: dict[str, int], value):
        return value <= F.coalesce(F.create_map(*(F.lit(x) for pair in bars.items() for x in pair))[F.col("l")], F.lit((1 << 63) - 1)) if bars else F.lit(True)

    # languages with more rows are first thinned by their hash, so that few hashes are ranked (a number for each language and row)
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).where(F.col("n") > 4 * sample).collect()
    rows = rows.where(upto({r["l"]: int(2 * sample / r["n"] * (1 << 30)) for r in sizes}, F.pmod("h", F.lit(1 << 30))))
    hashes: dict[str, list[int]] = {}
    for r in rows.select("l", "h").distinct().collect():
        hashes.setdefault(r["l"], []).append(r["h"])
    chosen = rows.where(upto({x: sorted(found)[sample - 1] for x, found in hashes.items() if len(found) > sample}, F.col("h")))
    return Filters.fit([(r["t"], r["l"]) for r in chosen.groupBy("l", "h").agg(F.min("t").alias("t")).collect()])


def identify(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """df with lang_pred, score and evidence."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(filters)  # 8 bytes x 2^SLOT_BITS for each 64 languages
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "evidence")]
    df, at = df.select(*kept), kept.index(text)

    def run(batches):
        found = held.value
        for batch in batches:
            said = [found.judge(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.float64())], [*kept, "lang_pred", "score", "evidence"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "lang_pred string, score double, evidence double"]))


def remainder(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit(docs.where(remainder(4) != 2))
    return identify(docs.select("doc_id", (remainder(4) == 2).alias("held_out"), "text"), filters).drop("text")
