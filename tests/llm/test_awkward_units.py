"""Texts of one awkward unit: no task may fail or take more than linear time."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import language, mixing, personal, warc
from tallyspark.llm.html_blocks import CHROME, blocks
from tallyspark.llm.minhash import near_duplicates

PAGES = ["<p x", "<a '", '<a "', "<a '>'", "<a b='>", "<p x>", "</", "<!--", "<!", "< ", "&#", "&#9", "&#x9", "<form>", "<svg>", "<a <a '<a >'"]
TEXTS = ["b.", "a@b.", "10.0.0.1 ", "1", "+1 ", "password=", "'", "x", "AKIA", "(555) "]


def seconds(page):
    started = time.perf_counter()
    blocks(page)
    return time.perf_counter() - started


@pytest.mark.parametrize("unit", PAGES)
@pytest.mark.parametrize("end", ["", ">", "\"'>"])
def test_time_of_a_page_is_linear(unit, end):
    size = 1 << 20
    page = unit * (size // len(unit)) + end
    assert seconds(page) < 20
    small, large = (min(seconds(unit * (n // len(unit)) + end) for _ in range(3)) for n in (size // 8, size // 2))
    assert large < 0.3 or large < 4 * 2.3 * small


def test_personal_data_in_long_units(spark):
    model = personal.Model({"bias": 0.0})
    long = [unit * (200_000 // len(unit)) for unit in ("b.", "x", "1", "'", "x@" + "b." * 40_000 + "com")]
    rows = long + [unit * (5_000 // len(unit)) for unit in TEXTS]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    found = {row["doc_id"]: row for row in personal.digest(docs, model).collect()}
    assert len(found) == len(rows) and found[4]["n_email"] == 1
    assert found[len(long) + TEXTS.index("10.0.0.1 ")]["n_ip"] == 5_000 // 9


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "rot13", "hex", "utf-16", "nope", "'"])
def test_any_charset_gives_text(charset):
    assert "caf" in warc.plain_text(b"caf\xe9 <b>x", f"text/plain; charset={charset}") or charset in ("utf-16", "punycode")


def test_numbers_beyond_all_characters():
    page = "<p>&#65; &#x42; &#" + "9" * 6000 + "; &#" + "0" * 6000 + "67;"
    assert [block.text for block in blocks(page)] == ["A B � C"]


@pytest.mark.parametrize("page", [
    '<form id="aspnetForm"><div><p>the whole article stands in here</p></div></form>',
    '<article><p class="share-price">the whole article stands in here</p></article>',
    '<article><div class="menu-of-the-day">the whole article stands in here</div></article>',
    '<article><section id="social-history">the whole article stands in here</section></article>',
])
def test_text_in_forms_and_odd_classes_is_kept(page):
    assert [block.part != CHROME for block in blocks(page)] == [True]


@pytest.mark.parametrize("mark", ['class="cookie-banner"', 'id="site-footer"', 'class="x ad y"', 'class="main-nav"'])
def test_marks_beside_layout_words_are_furniture(mark):
    page = f"<div {mark}>gone</div><p>stays and is longer</p><form>search</form>"
    assert [block.text for block in blocks(page) if block.part != CHROME] == ["stays and is longer"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_meets_targets_without_ids(spark):
    rows = [(None if n % 5 < 3 else n % 40, f"w{n} " * (n % 17 + 1), "en", f"s{n % 3}", 0) for n in range(3000)]
    rows += [(None, "equal rows here", "en", "s0", 0)] * 500 + [(1, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs).select("source", "__mix.*").collect()
    assert len(mixed) == len(rows)
    for source in ("s0", "s1", "s2"):
        own = [row for row in mixed if row["source"] == source]
        largest = max(row["size"] for row in own)
        assert abs(sum(row["taken"] for row in own) - own[0]["target"]) <= largest
    again = mixing.mix(docs.repartition(7)).select("source", "__mix.*").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))


def test_an_id_links_through_each_of_its_texts(spark):
    rows = [(9, "a b c d e f"), (9, "u v w x y z"), (3, "a b c d e f"), (4, "u v w x y z"), (7, "other words in here"), (None, "a b c d e f")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((row["doc_id"] or 0, row["component_id"] or 0, row["kept"]) for row in found) == [
        (0, 0, True), (3, 3, True), (4, 3, False), (7, 7, True), (9, 3, False), (9, 3, False)
    ]


def test_pipeline_keeps_different_texts_of_an_id(spark):
    rows = [(7, "one text of these words", "en", "s", 1), (7, "another of quite different kind", "en", "s", 1), (8, "the third one stands alone here", "en", "s", 1)]
    rows += [(None, "copy without any id at all", "en", "s", 1)] * 3 + [(8, "the third one stands alone here", "en", "t", 1), (None, rows[0][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.deduplicated(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(row["text"] for row in kept.collect()) == sorted({row[1] for row in rows})
    assert kept.where("doc_id is null").count() == 1


def test_few_labelled_rows_give_whole_texts(spark):
    texts = ["ein langer Text über viele Dinge und ihre Namen " * 40, "noch ein anderer Text mit ganz anderen Worten darin " * 40]
    rows = spark.createDataFrame([("de", text, n) for n, text in enumerate(texts)], "language string, text string, key int")
    assert len(language.learn(rows)["de"]) == sum(map(len, (text.lower().encode() for text in texts))) + 1
