import random

from pyspark.sql import functions as F

from tallyspark.llm import extraction, suffix_index
from tallyspark.llm.suffix_index import LONG


def test_repeats_equal_brute_force(spark):
    chance = random.Random(3)
    rows = []
    for n in range(300):
        words = [chance.choice(("ab", "c", "ab", "c", "def")) for _ in range(chance.choice([0, 1, 5, 7, 8, 9, 30, 60]))]
        cut = chance.randrange(len(words) + 1)
        halves = [" ".join(part) for part in (words[:cut], words[cut:]) if part]
        kinds = b"CM" if len(halves) == 2 else b"M" * len(halves)
        rows.append((n << 13, chance.choice(["x", "y"]), n % 3 == 0, kinds, "\n".join(halves), n % 200))
    frame = spark.createDataFrame(
        rows, "row long, group string, loose boolean, lines binary, text string, same long"
    ).repartition(5)
    digits = suffix_index.recurring_digits(frame).groupBy("row").agg(F.collect_list("digit").alias("digits"))
    found = {tuple(row) for row in suffix_index.repeats(frame.join(digits, "row")).collect()}
    having, places = {}, []
    for row, group, _, kinds, text, same in rows:
        inner = [k == ord("M") for k, line in zip(kinds, text.split("\n")) for _ in line.split()]
        words = text.split()
        for at in range(max(1, len(words) - LONG + 1) if words else 0):
            window = (group, *words[at : at + LONG])
            within = all(inner[at : at + LONG])
            having.setdefault(window, (set(), set()))[within].add(same)
            places.append((row, at, window))
    wanted = {
        (row, at, len(having[w][0]), len(having[w][1]))
        for row, at, w in places
        if len(having[w][0]) + len(having[w][1]) > 1
    }
    rows_of = {}
    for row, _, w in places:
        rows_of.setdefault(w, set()).add(row)
    alone = {(row, at) for row, at, w in places if len(rows_of[w]) == 1}
    assert {one for one in wanted if one[:2] not in alone} == {one for one in found if one[:2] not in alone}
    assert found <= wanted and len(found) > 1000


def test_the_index_decides_on_marked_and_open_pages(spark):
    def words(*of):
        chance = random.Random(repr(of))
        return " ".join("w" + str(chance.randrange(10**9)) for _ in range(12))

    notice, strip, quote = words("notice"), words("strip"), words("quote")
    pages = []
    for n in range(12):  # a notice in every article, a passage three share, text beside the mark
        passage = f"<p>{quote}</p>" if n < 3 else ""
        body = "".join(f"<p>{words(n, part)}</p>" for part in range(4))
        article = f"<article>{body}{passage}<div>{notice}</div></article>"
        pages.append((n, f"http://a.example/{n}", f"<div>{strip}</div><div>{words(n, 'lead')}</div>{article}<div>more</div>"))
    for n in range(20, 40):  # without marks: a strip on all pages, a passage that two share
        passage = f"<p>{quote}</p>" if n < 22 else ""
        pages.append((n, f"http://b.example/{n}", f"<p>{strip}</p><p>{words(n)}</p>{passage}<p>{words(n, 1)}</p>"))
    pages.append((50, "http://c.example/", f"<article>{words(50)} {words(50, 1)}</article><div>{strip}</div>"))
    frame = spark.createDataFrame([(str(n), *page) for n, *page in pages], "page_id string, url string, html string")
    found = {int(row["page_id"]): row["text"].split("\n") for row in extraction.extract(frame).collect()}
    for n in range(12):
        body = [words(n, part) for part in range(4)]
        assert found[n] == [words(n, "lead"), *body, *([quote] if n < 3 else [])]
    for n in range(20, 40):
        assert found[n] == [words(n), *([quote] if n < 22 else []), words(n, 1)]
    assert found[50] == [words(50) + " " + words(50, 1)]
