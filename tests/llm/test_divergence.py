import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import divergence
from tallyspark.llm.radix import radix_order
from tallyspark.llm.byte_terms import LETTERS, lowering_table, term_bounds

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, *row, "x", 9, "y") for i, row in enumerate(rows)], SCHEMA)


def terms_of(text):
    lower = re.sub("[A-Z]+", lambda found: found[0].lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, ranks):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    found = set()
    for lang, sources in groups.items():
        kept = [term for term, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for source in sources:
            whole.update({term: counts[lang, source][term] for term in kept})

        def shares(own):
            everything = sum(own[term] for term in kept) + len(kept)
            return {term: 1 + 10**9 * (own[term] + 1) // everything for term in kept}

        q_lang = shares(whole)
        p = {source: shares(counts[lang, source]) for source in sources}
        for source in sources:
            parts = {"pair": [], "term": []}
            for other in sources - {source}:
                pairs = ((p[source][term], p[other][term]) for term in kept)
                parts["pair"].append((-sum((a - b) ** 2 // b for a, b in pairs), other.encode()))
            for term in kept:
                a, b = p[source][term], q_lang[term]
                if counts[lang, source][term] and a > b:
                    parts["term"].append((-((a - b) ** 2 // b), term.encode()))
            for part, values in parts.items():
                values = sorted(values)[: ranks if part == "term" else None]
                for rank, (value, item) in enumerate(values, 1):
                    found.add((lang, source, part, item.decode(), -value, rank))
    return found


def result(frame):
    return [tuple(row) for row in frame.select("lang", "source", "part", "item", "value", "rank").collect()]


def test_equals_brute_force_on_odd_rows(spark, monkeypatch):
    chance = random.Random(5)
    vocabulary = [chance.choice("abcdéß中") * chance.randint(1, 30) for _ in range(60)]
    vocabulary += ["A1b", "don't", "🙂", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq"]
    rows = [
        (" ".join(chance.choices(vocabulary, k=chance.randint(0, 40))), f"l{chance.randrange(2)}", f"s{min(chance.randrange(12), 6)}")
        for _ in range(150)
    ]
    rows += [(None, None, None), ("", "l0", "only empty"), ("x y z", "rare", "s"), ("x", "rare", None)]
    rows += [("same words here", "copies", "s")] * 3 + [("Same WORDS here", "copies", "t")]
    rows += [("z" * 300_000 + " a " * 50_000, "l1", "s1"), ("12 34 !!", "l1", "digits")]
    monkeypatch.setattr(divergence, "_CELL_TERMS", 7)
    monkeypatch.setattr(divergence, "_CELL_SOURCES", 2)
    found = result(divergence.audit(table(spark, rows).repartition(3), ranks=5))
    assert len(found) == len(set(found))
    assert set(found) == brute(rows, 5)


def test_small_buffers_give_the_same_counts(spark, monkeypatch):
    rows = [(f"w{'abc'[n % 3]} common {'long' * 6} {'x' * (n % 25)}", "l", f"s{n % 2}") for n in range(200)]
    monkeypatch.setattr(divergence, "_HELD", 8)
    assert set(result(divergence.audit(table(spark, rows)))) == brute(rows, 200)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).collect() == []


def test_counts_beyond_nine_billion_stay_exact(spark):
    n, everything = 12_345_678_901_234, 98_765_432_109_876
    row = spark.range(1).select(
        divergence._share(divergence.F.lit(n), divergence.F.lit(everything)).alias("p")
    )
    assert row.first()["p"] == 1 + 10**9 * (n + 1) // everything


@pytest.mark.parametrize("seed", range(3))
def test_packed_terms_sort_as_bytes(seed):
    chance = random.Random(seed)
    terms = ["".join(chance.choices("abzé", k=chance.randint(1, 8))).encode()[:16] for _ in range(500)]
    joined = np.frombuffer(b" ".join(terms) + b" " * 16, np.uint8)
    starts, lengths = term_bounds(joined)
    keys = divergence.packed(joined, starts, lengths, 2)
    assert [terms[at] for at in radix_order(keys)] == sorted(terms)


def test_table_lowers_ascii_letters_only():
    assert "Ab1 É-c".encode().translate(lowering_table(LETTERS)) == "ab  É c".encode()
