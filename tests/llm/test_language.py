import zlib

import numpy as np

from quaylark.llm import language


def test_held_out_accuracy(spark):
    rows = language.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()
    lang = {r.doc_id: r.lang for r in docs}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_contain_what_they_learned():
    rows = [("the cat and the hat " * 5, "en"), ("der hund und die katze " * 5, "de")] * 3
    filters = language.Filters.fit(rows)
    for text, lang in rows[:2]:
        assert (filters.masks(language.grams(language.normal(text))) & np.uint64(1 << filters.langs.index(lang))).any()
        assert filters.predict(text)[0] == lang
    assert filters.predict(None) == ("und", 0.0) and filters.predict("12 ***\n") == ("und", 0.0) and filters.predict("") == ("und", 0.0)
    long = "the cat and the hat " * 200_000
    assert filters.predict(long)[0] == "en"


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    df = spark.createDataFrame([(1, "the cat sat", "en", "x"), (1, "the cat sat", "en", "x"), (None, None, None, None), (3, "", "fr", "")], schema)
    got = language.identify(df, language.fit(df)).collect()
    assert [r.lang_pred for r in got] == ["en", "en", "und", "und"]
    empty = df.limit(0)
    assert language.identify(empty, language.fit(empty)).collect() == []
    assert [r.lang_pred for r in language.identify(df, language.fit(empty)).collect()] == ["und"] * 4


def test_more_languages_than_bits_of_a_word():
    alphabets = {f"l{k:03}": chr(0x4E00 + 40 * k) for k in range(130)}
    said = {lang: " ".join(chr(ord(first) + j) + chr(ord(first) + j + 1) for j in range(20)) for lang, first in alphabets.items()}
    filters = language.Filters.fit([(text, lang) for lang, text in said.items()] * 3)
    assert filters.langs == sorted(said)
    assert {lang: filters.predict(text)[0] for lang, text in said.items()} == {lang: lang for lang in said}


def test_signs_are_no_letters():
    filters = language.Filters.fit([("the cat and the hat " * 5, "en")] * 3)
    for text in ("²", "½ ①", "—“”…", "٣٤", "12 ***"):
        assert filters.predict(text) == ("und", 0.0)
    assert language.normal("The—“cat” ½ né") == " the cat né ".encode()


def test_every_language_is_sampled(spark):
    common_, rare = "the cat and the hat", "der hund und die katze"
    rows = [(k, common_, "en") for k in range(300)] + [(k, f"{common_} {k}", "en") for k in range(300, 600)] + [(1000, rare, "de"), (1001, rare + " so", "de"), (1002, rare, "de")]
    filters = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), sample=10)
    assert filters.langs == ["de", "en"] and filters.predict(rare)[0] == "de"


def brute_counts(filters, text):
    """Share of n-grams for each language from plain sets of slots, a language at a time."""
    data = language.normal(text)
    found = [data[i : i + n] for n in language.SIZES for i in range(len(data) - n + 1)]
    out = []
    for k, lang in enumerate(filters.langs):
        have = {s for s, word in enumerate(filters.table[k // 64].tolist()) if word >> (k % 64) & 1}
        n = 0
        for gram in found:
            code = 0
            for b in gram:
                code = (code << 8) | b
            places = language.slots(np.array([(code << 8) | len(gram)], np.uint64))
            n += all(int(p[0]) in have for p in places)
        out.append(max(0.0, (n - len(found) * filters.false[k]) / (1 - min(filters.false[k], 0.99))) / len(found))
    return out


def test_prediction_against_plain_sets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    filters = language.fit(docs.where(language.remainder(4) != 2))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").orderBy("doc_id").limit(25).collect()
    for r in rows:
        lang, score = filters.predict(r.text)
        share = brute_counts(filters, r.text)
        if lang != "und":
            assert lang == filters.langs[int(np.argmax(share))] and abs(score - max(share) / sum(share)) < 1e-9


def test_evidence(spark):
    filters = language.Filters.fit([("the cat and the hat " * 5, "en")] * 3)
    assert filters.judge("the cat")[2] > 0.9 and filters.judge("жжж щщщ")[2] == 0.0
    got = language.identify(spark.createDataFrame([("the hat", "e"), ("ЖЩ", "e")], "text string, evidence string"), filters).collect()
    assert [r.evidence > 0 for r in got] == [True, False]
