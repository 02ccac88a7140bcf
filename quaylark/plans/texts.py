"""Text queries on documents, pages and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaylark.functions import text as X
from quaylark.plans.registry import query
from quaylark.plans.tables import rounded, table


@query(r"""WITH u AS (SELECT page_id, url, 'https://' || regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages),
c AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END AS canonical FROM u) SELECT page_id, canonical, left(sha1(canonical), 16) AS article_id FROM c""")
def canonical_url_id(spark, d):
    rows = table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))
    return rows.withColumn("article_id", X.short_sha1(F.col("canonical")))


_HASH = r"CASE WHEN t = '' THEN '' ELSE left(sha1(left(t, 2000)), 16) END"


@query(rf"""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS t FROM documents), h AS (SELECT doc_id, {_HASH} AS text_hash FROM n)
SELECT doc_id, text_hash, count(*) OVER (PARTITION BY text_hash) > 1 AND text_hash <> '' AS dup FROM h""")
def text_hash_dups(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))
    return rows.withColumn("dup", (F.count("*").over(Window.partitionBy("text_hash")) > 1) & (F.col("text_hash") != ""))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) > 50 THEN 'high' ELSE 'low' END AS size FROM events")
def json_label_map(spark, d):
    rows = table(spark, d, "events").select("event_id", F.element_at(X.number_map(F.col("props"), ["k", "z"]), "k").alias("k"))
    return rows.withColumn("size", F.when(F.col("k") > 50, "high").otherwise("low"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"#]+)', 1), 1) - 1 AS pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS root FROM pages),
f AS (SELECT page_id, pos, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN starts_with(href, '/') THEN root || href ELSE root || '/' || href END, '[?#].*$', '') AS link FROM l)
SELECT page_id, link, CAST(min(pos) AS INTEGER) AS pos FROM f WHERE regexp_matches(link, '^https?://[^/]*example[.](com|net)') GROUP BY 1, 2""")
def link_extract_dedup(spark, d):
    return X.page_links(table(spark, d, "pages"), "page_id", "html", "url", "^https?://[^/]*example[.](com|net)")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS heading,
length(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) >= 100 AS long_enough FROM pages""")
def article_parse(spark, d):
    parts = X.page_parts(F.col("html"))
    return table(spark, d, "pages").select("page_id", parts["title"].alias("title"), parts["heading"].alias("heading"), (F.length(parts["body"]) >= 100).alias("long_enough"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(password|secret|token)', 'i') THEN 'secret' WHEN regexp_matches(text, 'license|copyright', 'i') THEN 'license' WHEN lang <> 'en' THEN 'foreign' ELSE 'plain' END AS kind FROM documents""")
def weak_labels(spark, d):
    from quaylark.operators.relational import ordered_case

    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", ordered_case([(t.rlike("(?iu)(password|secret|token)"), "secret"), (t.rlike("(?iu)license|copyright"), "license"), (F.col("lang") != "en", "foreign")], "plain").alias("kind"))


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_À-ɏ])the ([^a-z0-9_]|[a-z])*?') AS the_, contains(lower(text), 'token') OR contains(lower(text), 'idiot') AS any_ FROM documents WHERE false UNION ALL SELECT doc_id, regexp_matches(' ' || regexp_replace(text, '[^A-Za-z0-9_À-ɏ]', ' ', 'g') || ' ', ' that ', 'i'), contains(lower(text), 'token') OR contains(lower(text), 'idiot') FROM documents")
def phrase_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_phrase(F.col("text"), "that").alias("the_"), X.contains_any(F.col("text"), ["token", "idiot"]).alias("any_"))


@query("""WITH w AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS i, lower(text) AS t FROM documents), s AS (SELECT doc_id, substr(t, i + 1, 1000) AS s FROM w),
c AS (SELECT doc_id, CAST(contains(s, 'that ') AS INTEGER) + CAST(contains(s, 'with ') AS INTEGER) + CAST(contains(s, 'from ') AS INTEGER) + CAST(contains(s, 'this ') AS INTEGER) AS n, contains(s, 'was ') OR contains(s, 'which ') AS m FROM s)
SELECT doc_id, bool_or(n >= 3 AND m) AS kept FROM c GROUP BY doc_id""")
def window_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", X.window_filter(F.col("text"), ["that ", "with ", "from ", "this "], ["was ", "which "]).alias("kept")).where("kept IS NOT NULL")


_CONCEPTS = {"insult": ["idiot", "moron", "clown"], "secret": ["token", "password"], "licence": ["license", "mit license", "apache license"]}


def _named(words: str) -> str:
    return rf"regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents),
c AS (SELECT doc_id, concat_ws(',', CASE WHEN {_named('idiot|moron|clown')} THEN 'insult' END, CASE WHEN {_named('license|mit license|apache license')} THEN 'licence' END, CASE WHEN {_named('token|password')} THEN 'secret' END) AS concepts FROM d)
SELECT doc_id, concepts FROM c WHERE concepts <> ''""")
def keyword_tagging(spark, d):
    return X.tag(table(spark, d, "documents").select("doc_id", "text"), "text", _CONCEPTS).where(F.size("tags") > 0).select("doc_id", F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("concepts"))


def _exact(word: str) -> str:
    return _named(word).replace("(low,", "(text,")


@query(f"""WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
m AS (SELECT doc_id, 'TOK' AS entity, CASE WHEN NOT (contains(low, 'the') OR contains(low, 'de')) THEN NULL WHEN {_named('token')} THEN 'token' WHEN {_exact('TOK')} THEN 'TOK' END AS matched FROM d
UNION ALL SELECT doc_id, 'IDI', CASE WHEN {_named('idiot')} THEN 'idiot' WHEN {_exact('IDI')} THEN 'IDI' END FROM d
UNION ALL SELECT doc_id, 'LIC', CASE WHEN {_named('mit license')} THEN 'mit license' WHEN {_named('license')} THEN 'license' WHEN {_exact('LIC')} THEN 'LIC' END FROM d
UNION ALL SELECT doc_id, 'DUP', CASE WHEN {_exact('DUP')} THEN 'DUP' END FROM d)
SELECT doc_id, entity, matched FROM m WHERE matched IS NOT NULL""")
def entity_match(spark, d):
    aliases = {"TOK": ["token"], "IDI": ["idiot", "clown"], "LIC": ["mit license", "license"], "DUP": ["clown"]}
    return X.match_entities(table(spark, d, "documents"), "doc_id", "text", aliases, {"TOK": ["the", "de"]})


@query(r"""WITH d AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT count(*) AS n FROM d),
t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 5),
x AS (SELECT doc_id, t.w, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM t JOIN f ON f.w = t.w, n), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM x GROUP BY 1)
SELECT x.doc_id, x.w AS term, round(x / l, 6) AS weight FROM x JOIN l ON l.doc_id = x.doc_id QUALIFY row_number() OVER (PARTITION BY x.doc_id ORDER BY round(x / l, 9) DESC, x.w) <= 3""")
def tfidf_top_terms(spark, d):
    from quaylark.operators.models import tfidf

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "").alias("terms"))
    x = tfidf(docs, 5).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term")))
    return x.where("k <= 3").select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


@query(r"""WITH d AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM documents), n AS (SELECT count(*) AS n FROM d),
t AS (SELECT doc_id, source, w, count(*) AS tf FROM (SELECT doc_id, source, unnest(w) AS w FROM d) GROUP BY 1, 2, 3), f AS (SELECT w, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT doc_id, source, t.w, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM t JOIN f ON f.w = t.w, n), l AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS v FROM x),
c AS (SELECT a.doc_id, b.doc_id AS other, sum(a.v * b.v) AS c FROM l a JOIN l b ON a.source = b.source AND a.w = b.w AND b.doc_id < a.doc_id AND b.doc_id >= a.doc_id - 200 GROUP BY 1, 2)
SELECT d.doc_id, round(1 - coalesce(max(c), 0), 5) AS novelty FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY 1""")
def novelty_cosine(spark, d):
    from quaylark.operators.models import nearest_before

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ").alias("words"))
    return nearest_before(docs, 2, 200).select(F.col("id").alias("doc_id"), rounded(1 - F.col("c"), 5).alias("novelty"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(source || ', ' || lang || ',zz', ','), lambda x: trim(x)), lambda x: x IN ('en', 'fr', 'src1', 'src2')))), ',') AS groups FROM documents")
def keyword_groups(spark, d):
    return table(spark, d, "documents").select("doc_id", X.known_groups(F.concat_ws(",", F.concat("source", F.lit(",")), F.concat(F.lit(" "), "lang"), F.lit("zz")), ["en", "fr", "src1", "src2"]).alias("groups"))


@query("SELECT doc_id, CASE WHEN length(text) > 1200 THEN left(text, 900) || chr(10) || '[...]' || chr(10) || right(text, 300) ELSE text END AS said FROM documents")
def middle_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", X.middle_cut(F.col("text"), 1200, 900).alias("said"))


@query("""SELECT md5(text) AS request, count(*) AS rows_, count(DISTINCT source) AS targets, CASE WHEN count(DISTINCT source) = 1 THEN min(source) ELSE 'MULTI' END AS scope FROM documents GROUP BY md5(text)""")
def request_dedup(spark, d):
    """One request for each text with the union of its targets, and how many rows it answers."""
    rows = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("request")).agg(F.count("*").alias("rows_"), F.array_sort(F.collect_set("source")).alias("t"))
    return rows.select("request", "rows_", F.size("t").cast("long").alias("targets"), X.scope(F.col("t")).alias("scope"))


@query("""WITH l AS (SELECT event_id, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN value > 50 THEN 'good' WHEN value < 50 THEN 'bad' ELSE 'even' END AS sign, CASE WHEN k >= 80 THEN 'high' WHEN k >= 40 THEN 'middle' ELSE 'low' END AS confidence, value BETWEEN 0 AND 490 AND k BETWEEN 0 AND 99 AS valid FROM l""")
def label_fanout_valid(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v > 50, "good").when(v < 50, "bad").otherwise("even").alias("sign"), F.when(k >= 80, "high").when(k >= 40, "middle").otherwise("low").alias("confidence"), (v.between(0, 490) & k.between(0, 99)).alias("valid"))
