"""BPE encoding and decoding with a vocabulary file of a public tokenizer (BPE with word ends, lower case).

Method: a contiguous rank array. For each short word, two arrays are held: the boundaries of its parts and, beside them,
the rank of the merge of each part with its right neighbour. The array is scanned for its least rank, the boundary
between that pair is deleted and the two neighbouring ranks are looked up again, until no rank is left. Words are short,
so a scan of a small array beats any queue. Words of more than SHORT bytes (long runs of letters, texts without spaces) would
take time by the square of their length: their parts are a linked list and their ranks a heap, with the same ids. Texts are first normalised and cut into words as the file says (NFC, white
space runs to one space, lower case per character; contractions, runs of letters, single digits, runs of other signs;
bytes as characters); its special strings are matched first and stand for themselves.

Words that repeat are taken from a table that is emptied when full, so a worker's memory is bounded.

Null and empty texts have no tokens. Rows are independent: repeated rows and null ids keep their own result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.session import ship

#: Words kept in a worker's table.
CACHE_WORDS = 300_000
#: A word that this many characters long or longer is merged but not kept.
CACHE_CHARS = 64
#: Bytes of a word from which a heap takes the place of the scans.
SHORT = 128
NO_RANK = 1 << 30


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class Bpe:
    """Encodes and decodes as the file at path says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.ids = vocab
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.names = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.names = [self.names.get(k, "") for k in range(max(self.names) + 1)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {a + "\0" + b: k for k, (a, b) in reversed(list(enumerate(pairs)))}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_characters()
        self.table: dict[str, bytes] = {}
        if any(c + end not in vocab for c in self.bytes for end in {"", self.suffix}):
            raise ValueError(f"{path}: the vocabulary lacks a byte, so words could not be said whole")

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower case of each character by itself; only a capital sigma would look at its neighbours
        return text.replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[int]:
        """The word's ids: see the module's method."""
        signs = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        signs[-1] += self.suffix
        parts = self._merged(signs) if len(signs) <= SHORT else self._merged_long(signs)
        return [self.ids[p] for p in parts]

    def _merged(self, parts: list[str]) -> list[str]:
        rank = self.rank.get
        # parts[k] is the text from boundary k to boundary k + 1; ranks[k] that of parts[k] and parts[k + 1]
        ranks = [rank(a + "\0" + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            k = ranks.index(least)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + "\0" + parts[k + 1], NO_RANK)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + "\0" + parts[k], NO_RANK)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same by a heap of (rank, place): the least rank, the leftmost of equal ones; stale entries are passed over."""
        rank, n = self.rank.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(parts[k] + "\0" + parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if not parts[k] or right >= n or rank(parts[k] + "\0" + parts[right]) != r:
                continue
            parts[k] += parts[right]
            parts[right] = ""
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (r := rank(parts[k] + "\0" + parts[right])) is not None:
                    heapq.heappush(heap, (r, k))
            if (left := before[k]) >= 0 and (r := rank(parts[left] + "\0" + parts[k])) is not None:
                heapq.heappush(heap, (r, left))
        return [p for p in parts if p]

    def encoded(self, word: str) -> bytes:
        out = np.array(self.merge(word), "<u4").tobytes()
        if len(word) < CACHE_CHARS:
            if len(self.table) >= CACHE_WORDS:
                self.table.clear()
            self.table[word] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_re is not None and any(s in text for s in self.special):
            out, last = [], 0
            for m in self.special_re.finditer(text):
                out += [self._plain(text[last : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                last = m.end()
            return b"".join([*out, self._plain(text[last:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        get, encoded = self.table.get, self.encoded
        return b"".join([get(w) or encoded(w) for w in self.word.findall(self.normal(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts with a space between, as a file without decoder asks for."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def text(self, ids: list[int]) -> str:
        """The text that the ids stand for: bytes put together, a space after each word."""
        back = {c: b for b, c in enumerate(self.bytes)}
        out = []
        for i in ids:
            name = self.names[i]
            end = bool(self.suffix) and name.endswith(self.suffix)
            out.append(bytes(back[c] for c in (name[: -len(self.suffix)] if end else name)) + b" " * end)
        return b"".join(out).decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """df with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded (string)."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")]
    df = df.select(*kept)
    at = kept.index(text)
    extra = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    extra += [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * decoded

    def run(batches):
        coder = bpe(path)
        for batch in batches:
            n, shas, back, all_ids, all_texts = [], [], [], [], []
            for value in batch.column(at):
                data = coder.encode_bytes(value.as_py() or "")
                found = np.frombuffer(data, "<u4")
                said = coder.decode(found.tolist())
                n.append(len(found))
                shas.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest())
                if ids:
                    all_ids.append(found.astype(np.int32))
                if decoded:
                    all_texts.append(said)
            columns = [n, shas, back, *[all_ids] * ids, *[all_texts] * decoded]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, (_, kind) in zip(columns, extra))], [*kept, *(name for name, _ in extra)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * ids, *["decoded string"] * decoded])
    return df.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_path(), ids=False, decoded=False).drop("text")
