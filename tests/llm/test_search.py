import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import search as search_module
from tallyspark.llm.search import search

DOCS = "doc_id long, text string, term string, n int, row string, item string"
ITEMS = "item_id long, text string, term string, place int"


def table(spark, rows):
    return spark.createDataFrame([(i, text, "x", 3, "y", "z") for i, text in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, text, "x", 3) for i, text in rows], ITEMS)


def terms_of(text):
    lower = re.sub("[A-Z]+", lambda found: found[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, queries, k):
    counts = [(i, Counter(terms_of(text))) for i, text in docs]
    counts = [(i, found, sum(found.values())) for i, found in counts if found]
    all_docs, all_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(term for _, found, _ in counts for term in found)
    asked = defaultdict(set)
    for item, text in queries:
        asked[item] |= set(terms_of(text))
    rows = []
    for item, terms in asked.items():
        scored = []
        for i, found, n in counts:
            m = 10 + 90 * n * all_docs // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df[term] + 1)))
                * (10**9 * found[term] // (1000 * found[term] + 8 * m))
                for term in terms & set(found)
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1):
            rows.append((item, rank, i, -score))
    return sorted(rows, key=repr)


def result(frame):
    return sorted((tuple(row) for row in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("first_block, k", [(1, 3), (4, 10), (256, 10)])
def test_equals_brute_force(spark, monkeypatch, first_block, k):
    monkeypatch.setattr(search_module, "FIRST_BLOCK", first_block)
    chance = random.Random(first_block)
    vocabulary = [f"w{int(chance.paretovariate(0.6))}" for _ in range(300)] + ["É", "a1", "中文"]
    docs = [(n, " ".join(chance.choices(vocabulary, k=chance.randint(0, 60)))) for n in range(300)]
    docs += [(1000 + n, "tied w1 copy of one text") for n in range(40)]  # far more ties than places
    docs += [(5, "repeated id w2"), (5, "repeated id w2"), (5, "another W3"), (None, "w1 w2 no id")]
    docs += [(2000, None), (2001, ""), (2002, "!!! ---"), (2003, "w1 " * 60_000 + "rare")]
    queries = [(n, " ".join(chance.choices(vocabulary, k=chance.randint(1, 80)))) for n in range(12)]
    queries += [(50, "tied w1"), (51, None), (52, "?!"), (53, "unknownword"), (54, "RARE rare, w1")]
    queries += [(55, "w2"), (55, "W3 w2"), (None, "copy"), (56, " ".join(f"w{n}" for n in range(150)))]
    found = result(search(table(spark, docs).repartition(3), items(spark, queries), k=k))
    assert found == brute(docs, queries, k)


def test_empty_tables(spark):
    docs, asked = table(spark, [(1, "a b")]), items(spark, [(1, "a")])
    assert search(docs.limit(0), asked).collect() == []
    assert search(docs, asked.limit(0)).collect() == []


def test_closed_items_read_candidates_only(spark, monkeypatch):
    """Once an item is closed, its rows are those of its candidates, not those of its lists."""
    monkeypatch.setattr(search_module, "FIRST_BLOCK", 8)
    docs = [(n, "word filler" + " pad" * (n % 199)) for n in range(2000)]
    docs += [(5000 + n, "needle " * (n + 1)) for n in range(20)]
    kept = {}

    def watched(frame, label, by=None):
        made = search_module_saved(frame, label, by)
        if label == "search-intervals":
            kept.setdefault("rows", []).append(made.frame.count())
        return made

    search_module_saved = search_module.saved
    monkeypatch.setattr(search_module, "saved", watched)
    found = search(table(spark, docs), items(spark, [(1, "needle word filler")]), k=3)
    assert [row["doc_id"] for row in found.orderBy("rank").collect()] == [5019, 5018, 5017]
    assert len(kept["rows"]) > 2 and max(kept["rows"][2:]) <= 20
