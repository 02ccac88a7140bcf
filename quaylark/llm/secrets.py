"""Secret scans: fixed patterns, and strings that a primed compressor finds new.

Base kinds, leftmost and not overlapping within a kind, spans in code points with an exclusive end:
assign (a sensitive name, = or :, and a value of 6 or more characters), access (AKIA and capitals or digits, 20 or more
in all) and hex (24 or more hex digits). A span is the whole match.

Kind novel: strings of LONG letters, digits and +/_=- after a sensitive word are candidates: those up to the end of its line,
or REACH characters on where the line ends before, those up to the end of a block of a private key, and those near after a
string that was reported (further lines of a key, parts of a dotted token). A zstandard compressor is primed once with a
dictionary trained on common identifiers of code, which carries what signs and strings cost in code and words. The text
that surrounds a candidate (AROUND characters on either side) is compressed with and without the candidate behind it; the
difference, its marginal bytes, for each character says how much of it is new. Words, identifiers and values that the
surrounding text repeats cost little; keys can't be compressed and are reported: nothing but the compressor decides about a
candidate. Of candidates that overlap base spans the parts outside are measured, each on its own, from PART characters on. A
short last line of a key is reported with the line before. REACH, AROUND, LONG and NOVEL are parameters of scan().

Very long texts are read whole: the time is that of the compressor for each candidate. Equal starts: spans come in the order
of their kinds.

Null and empty texts have no spans. Rows are independent: repeated rows and null ids keep their own result. Other columns
pass through unless their names clash with the result's, which win.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.session import ship

KINDS = ("assign", "access", "hex", "novel")
# The contract's patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
NAMES = ("passw", "secret", "token", "api")
# Words after which a string may be secret
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "api key", "credential", "private_key", "private key", "access_key", "access key", "authorization", "bearer", "client_id", "signature")
SENSITIVE_RE = re.compile("|".join(map(re.escape, SENSITIVE)))
# Identifiers of code that the compressor knows beforehand
IDENTIFIERS = " ".join(
    "return import from class def self None True False function const let var public private static void string int float bool null "
    "http https www example com org net index html json yaml config settings default value name key token secret password user username "
    "email host port path file directory request response header content type application authorization bearer basic client server "
    "session cookie database connection string environment variable production development test staging version package module "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 placeholder changeme your_api_key_here "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 get_value set_value access_token refresh_token client_secret".split(" ")
).encode()

PEM_BEGIN, PEM_END = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"), "-----END"

#: Least characters of a candidate, and of a candidate's part outside base spans.
LONG, PART = 12, 6
#: Characters after a sensitive word that count where its line ends before, and those after a reported candidate.
REACH = 200
#: Characters on either side that a candidate is measured against.
AROUND = 400
#: Marginal compressed bytes for each character from which a string counts as new.
NOVEL = 0.75


@lru_cache(maxsize=1)
def dictionary() -> bytes:
    """The compressor's dictionary, trained on lines put together from the identifiers (always the same lines)."""
    rng, names = random.Random(0), IDENTIFIERS.decode().split()
    lines = [rng.choice([" ", "_", ".", "-"]).join(rng.choice(names) for _ in range(rng.randrange(6, 14))).encode() for _ in range(3000)]
    return zstandard.train_dictionary(8192, lines).as_bytes()


class Scanner:
    """Finds spans with a compressor primed by `trained`."""

    def __init__(self, trained: bytes | None = None, long: int = LONG, reach: int = REACH, around: int = AROUND, novel: float = NOVEL):
        primer = zstandard.ZstdCompressionDict(trained or dictionary())
        self.press = zstandard.ZstdCompressor(level=3, dict_data=primer, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.reach, self.around, self.novel = reach, around, novel
        self.candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % long)
        self.long = long
        self.rest = re.compile(r"(?:\s|\\[nr])+([A-Za-z0-9+/=]{1,%d})(?:\s|\\[nr])*" % (long - 1))

    def novelty(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes for each character of text[start:end]."""
        context = (text[end : end + self.around] + "\n" + text[max(0, start - self.around) : start]).encode("utf-8", "surrogatepass")
        value = text[start:end].encode()
        return (len(self.press.compress(context + value)) - len(self.press.compress(context))) / len(value)

    def contexts(self, text: str) -> list[tuple[int, int]]:
        """Where candidates may begin: from the end of each sensitive word, first and last place."""
        low = text.lower()
        if len(low) != len(text):  # lower case that changes lengths would move the spans
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out, line = [], -1
        for w in SENSITIVE_RE.finditer(low):
            if line < w.end():
                line = text.find("\n", w.end())
                line = len(text) if line < 0 else line
            out.append((w.end(), max(line, w.end() + self.reach)))
        return out

    def novel_spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out, done = [], 0
        covered: list[list[int]] = []  # known spans, overlapping ones as one
        for s, _, e in known:
            if covered and s < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        begins = [s for s, _ in covered]
        blocks = key_blocks(text)
        for start, last in sorted(self.contexts(text) + blocks):
            at = max(done, start)
            while (near := self.candidate.search(text, at, last + self.long)) and near.start() <= last:
                m = self.candidate.match(text, near.start())  # all of it, however long
                at = done = m.end()
                for s, e in uncovered(m.start(), m.end(), covered, begins):
                    if e - s >= PART and self.novelty(text, s, e) >= self.novel:
                        out.append((s, 3, e))
                        last = max(last, m.end() + self.reach)
                        k = bisect_right(blocks, (s, len(text))) - 1
                        if e == m.end() and k >= 0 and e < blocks[k][1] and (rest := self.rest.fullmatch(text, e, blocks[k][1])):
                            out.append((rest.start(1), 3, rest.end(1)))
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and base and novel spans, each in order."""
        base = base_spans(text)
        return base, sorted(base + self.novel_spans(text, base))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), in order."""
    low, out = text.lower(), []
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Where the bodies of private keys begin and end; blocks without an end are out."""
    out, end = [], 0
    for m in PEM_BEGIN.finditer(text):
        if end < m.end():
            end = text.find(PEM_END, m.end())
        if end < 0:
            break
        out.append((m.end(), end))
    return out


def uncovered(start: int, end: int, covered: list[list[int]], begins: list[int]):
    """The parts of start..end outside the covered spans, in order."""
    k = max(0, bisect_right(begins, start) - 1)
    while k < len(covered) and covered[k][0] < end:
        s, e = covered[k]
        if start < s:
            yield start, s
        start, k = max(start, e), k + 1
    if start < end:
        yield start, end


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and novel spans, with the default parameters."""
    return scanner().spans(text)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, last = [], 0
    for s, _, e in found:
        if s >= last:
            out += [text[last:s], mark]
        last = max(last, e)
    return "".join([*out, text[last:]])


def scan(df: DataFrame, text: str = "text", mark: str | None = None, long: int = LONG, reach: int = REACH, around: int = AROUND, novel: float = NOVEL) -> DataFrame:
    """df with n_assign, n_access, n_hex, n_novel, base_spans and spans (strings); with mark also clean (text, redacted; null stays null)."""
    ship(df.sparkSession)
    extra = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_novel", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())] + [("clean", pa.string())] * (mark is not None)
    kept = [c for c in df.columns if c not in {name for name, _ in extra}]
    df, at = df.select(*kept), kept.index(text)

    trained = dictionary()  # made once, so that all executors measure alike

    def run(batches):
        found = Scanner(trained, long, reach, around, novel)
        for batch in batches:
            columns = [[] for _ in extra]
            for value in batch.column(at):
                said = value.as_py()
                base, every = found.spans(said or "")
                row = [*(sum(k == kind for _, k, _ in every) for kind in range(4)), _joined(base), _joined(every)]
                if mark is not None:
                    row.append(said if said is None else redacted(said, every, mark))
                for column, x in zip(columns, row):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c, (_, kind) in zip(columns, extra))], [*kept, *(name for name, _ in extra)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in extra)])
    return df.mapInArrow(run, schema)


def base_digest(text: str) -> str:
    return hashlib.sha256(_joined(base_spans(text)).encode()).hexdigest()


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel")
