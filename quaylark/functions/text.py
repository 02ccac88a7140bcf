"""Text functions: canonical URLs, ids, fingerprints, phrases, tagging, entity matching, label JSON, request payloads.

Built-in expressions wherever they can say it. Unicode normalisation, longest-first tagging and entity matching are Arrow
functions: they are sequential within a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylark.session import ship


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without www., no query or fragment, no trailing slashes, https by default."""
    u = F.trim(url)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    out = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path))
    return F.when(F.length(F.trim(url)) > 0, out)


def short_sha1(text: Column) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def nfc(text: Column) -> Column:
    """Canonical composition, for which Catalyst has no function."""

    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))

    return F.pandas_udf(composed, T.StringType())(text)


def text_hash(text: Column, normalise: bool = True, chars: int = 2000) -> Column:
    """SHA-1 (16 hex) of the first characters of the text, composed, white space runs as one space, lower case; '' if empty."""
    t = nfc(text) if normalise else text
    flat = F.substring(F.lower(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))), 1, chars)
    return F.when(flat == "", "").otherwise(short_sha1(flat))


def known_groups(text: Column, vocabulary: list[str], sep: str = ",") -> Column:
    """Sorted distinct members of the vocabulary in a joined list."""
    # a JSON list of strings is read like a plain one
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]\"]", ""), sep), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.isin(vocabulary)))), sep)


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase as whole words, without regard to case, in any alphabet."""
    return text.rlike(r"(?iuU)(?<!\w)" + re.escape(phrase) + r"(?!\w)")


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def first_value(*columns: str) -> Column:
    """The first column with more than white space."""
    return F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns))


def middle_cut(text: Column, most: int = 12000, head: int = 9000, mark: str = "\n[...]\n") -> Column:
    """The head and the tail of a text longer than `most`."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(most - head)))).otherwise(text)


def digest(columns: list[str]) -> Column:
    """SHA-256 of a JSON object of the columns in order of their names; keys of maps in order too."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def sorted_map(value: Column) -> Column:
    """A map with its keys in order, so that equal maps have one JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def within(ts: Column, first: str, end: str, zone: str) -> Column:
    """first <= ts < end, with both given in a time zone's clock; ts is in UTC."""
    at = lambda s: F.to_utc_timestamp(F.lit(s).cast("timestamp"), zone).cast("timestamp_ntz")
    return (ts >= at(first)) & (ts < at(end))


def scope(targets: Column) -> Column:
    """The single target, MULTI or GENERAL."""
    return F.when(F.size(targets) == 1, targets[0]).when(F.size(targets) > 1, "MULTI").otherwise("GENERAL")


def number_map(text: Column, keys: list[str]) -> Column:
    """A JSON object's values as numbers, also where a value is an object with `score`; anything else is an empty map."""
    m = F.from_json(text, "map<string,string>")
    value = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)).try_cast("double"), F.get_json_object(F.try_element_at(m, F.lit(k)), "$.score").try_cast("double"))
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(value, keys))), lambda k, v: v.isNotNull())


def parsed_time(text: Column) -> Column:
    """ISO or dd/mm/yyyy with or without a time; null if neither."""
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    local = F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    clock = F.regexp_extract(text, r"(\d{1,2}:\d{2})(?::\d{2})?", 1)
    day = F.try_to_timestamp(F.concat_ws(" ", F.nullif(local, F.lit("")), F.coalesce(F.nullif(clock, F.lit("")), F.lit("00:00"))), F.lit("d/M/yyyy H:mm"))
    return F.coalesce(F.nullif(iso, F.lit("")).try_cast("timestamp"), F.when(local != "", day))


def page_parts(html: Column) -> dict[str, Column]:
    """Title, heading, canonical date candidates and body text of a page, by expressions."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    stamp = [F.regexp_extract(html, p, 1) for p in (r'(?i)<meta[^>]+published_time"[^>]+content="([^"]+)"', r'"datePublished"\s*:\s*"([^"]+)"', r'(?i)<time[^>]+datetime="([^"]+)"')]
    return {
        "title": flat(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)),
        "heading": flat(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "published": F.coalesce(*(parsed_time(F.nullif(s, F.lit(""))) for s in stamp)),
        "body": flat(F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)),
    }


def page_links(pages: DataFrame, key: str, html: str, base: str, hosts: str) -> DataFrame:
    """key, link, pos: absolute links to allowed hosts without query and fragment, each at its first place."""
    found = pages.select(key, base, F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)'), F.lit(1))).alias("pos", "href"))
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    full = F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(root, F.lit("/"), "href"))
    links = found.withColumn("link", F.regexp_replace(full, r"[?#].*$", "")).where(F.col("link").rlike(hosts))
    return links.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def tag(df: DataFrame, text: str, concepts: dict[str, list[str]], out: str = "tags") -> DataFrame:
    """df with out: concept to aliases found, longest alias first, no sign used twice, whole words."""
    ship(df.sparkSession)
    owner = {alias.casefold(): concept for concept, aliases in concepts.items() for alias in aliases}
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(a)}(?!\w)" for a in sorted(owner, key=len, reverse=True)) or r"(?!)")
    lengths = sorted({len(a) for a in owner}, reverse=True)

    def found(value: str | None) -> dict[str, list[str]]:
        low, out_, used = (value or "").casefold(), {}, []
        if not pattern.search(low):
            return {}
        for n in lengths:
            for alias in (a for a in owner if len(a) == n):
                for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", low):
                    if all(m.end() <= a or b <= m.start() for a, b in used):
                        used.append(m.span())
                        names = out_.setdefault(owner[alias], [])
                        names += [alias] * (alias not in names)
        return out_

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(found)

    return df.withColumn(out, F.pandas_udf(run, "map<string,array<string>>")(text))


def windows(text: Column, width: int, step: int) -> Column:
    """Overlapping windows of the text in lower case."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(F.lower(text), i + 1, F.lit(width)))


def _any(span: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(span, w))


def window_filter(text: Column, words: list[str], must: list[str], width: int = 1000, step: int = 500, least: int = 3, lead: int | None = None) -> Column:
    """Some window of the text holds `least` of the words and one of must; with lead, its first characters must hold one too."""
    count = lambda s: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(s, w)))
    found = F.exists(windows(text, width, step), lambda s: (count(s) >= least) & _any(s, must))
    return found if lead is None else found & _any(F.lower(F.substring(text, 1, lead)), must)


def legal_filter(text: Column, subject: list[str], legal: list[str], authority: list[str], strong: list[str], council: list[str], width: int = 2500, step: int = 1250) -> Column:
    """Some window holds the subject and a legal term, or an authority with a strong rule; a council's term counts as legal only
    beside an authority."""
    return F.exists(windows(text, width, step), lambda s: _any(s, subject) & (_any(s, legal) | (_any(s, authority) & (_any(s, strong) | _any(s, council)))))


def codes(text: Column, known: list[str], pattern: str = r"\b[A-Z0-9]{3}\b") -> tuple[Column, Column]:
    """Known and unknown codes of a text, sorted."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    listed = F.array(*map(F.lit, known))
    return F.array_intersect(found, listed), F.array_except(found, listed)


def match_entities(df: DataFrame, key: str, text: str, aliases: dict[str, list[str]], ambiguous: dict[str, list[str]]) -> DataFrame:
    """key, entity, matched: one row for each entity named in the text. Longest alias first, no sign used twice; an alias of
    two entities counts for none; capital tickers match as they are; ambiguous ones need a word of their context."""
    ship(df.sparkSession)
    owners: dict[str, set] = {}
    for entity, names in aliases.items():
        for name in [*names, entity]:
            owners.setdefault(name if name == entity else name.casefold(), set()).add(entity)
    single = sorted(((a, next(iter(o))) for a, o in owners.items() if len(o) == 1), key=lambda x: (-len(x[0]), x[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, value in zip(pdf[key], pdf[text]):
                said, low, used, got = value or "", (value or "").casefold(), [], {}
                for alias, entity in single:
                    if alias not in (said if alias == entity else low):
                        continue
                    for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", said if alias == entity else low):
                        free = all(m.end() <= a or b <= m.start() for a, b in used)
                        if free and (entity not in ambiguous or any(w in low for w in ambiguous[entity])):
                            used.append(m.span())
                            got.setdefault(entity, alias)
                rows += [(k, e, a) for e, a in got.items()]
            yield pd.DataFrame(rows, columns=[key, "entity", "matched"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, entity string, matched string")
