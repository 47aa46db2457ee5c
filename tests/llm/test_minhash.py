import random

import numpy as np
import pytest

from tallyspark.llm.minhash import near_duplicates, sketches
from tallyspark.llm.shingles import WordHasher, shingle_sets

SCHEMA = "doc_id long, text string, kept string, n int, bands string"


def table(spark, rows):
    return spark.createDataFrame([(i, text, "x", 1, "y") for i, text in rows], SCHEMA)


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        own = (text or "").encode().lower().split()
        width = min(words, len(own))
        sets[i] = {tuple(own[k : k + width]) for k in range(len(own) - width + 1)} if own else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for place, a in enumerate(ids):
        for b in ids[:place]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                first, second = sorted((find(a), find(b)))
                root[second] = first
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(frame):
    return {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in frame.collect()}


def test_components_equal_brute_force_with_a_hot_group(spark):
    chance = random.Random(3)
    vocabulary = [f"w{n}" for n in range(400)]
    base = [chance.choice(vocabulary) for _ in range(80)]
    rows = [(n, " ".join(chance.choices(vocabulary, k=chance.randint(1, 60)))) for n in range(60)]
    for n in range(60, 260):  # near copies of one text, many of them not near each other
        edited = list(base)
        for _ in range(chance.randint(0, 4)):
            edited[chance.randrange(80)] = chance.choice(vocabulary)
        rows.append((n, " ".join(edited)))
    rows += [(n, rows[n % 7][1].upper()) for n in range(260, 300)]  # copies
    assert result(near_duplicates(table(spark, rows), words=4)) == brute(rows, 4, 80)


def test_nulls_blanks_short_long_and_repeated_rows(spark):
    long_text = " ".join(f"t{n}" for n in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three")]
    rows += [(7, long_text), (8, long_text + " end"), (9, "x y z u v"), (9, "x y z u v")]
    rows += [(None, "one two")]
    found = near_duplicates(table(spark, rows), words=4).collect()
    by_id = {row["doc_id"]: row for row in found}
    assert len(found) == len(rows)
    assert [by_id[n]["component_id"] for n in range(1, 10)] == [1, 2, 3, 4, 4, 6, 7, 7, 9]
    assert [by_id[n]["n_shingles"] for n in (1, 2, 3, 4, 6, 7)] == [0, 0, 0, 1, 1, 29_997]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert not by_id[5]["kept"] and by_id[4]["kept"]


def test_empty_table(spark):
    assert near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 3, 40, 3000])
def test_sketches_fill_every_bin_and_estimate_similarity(size):
    chance = np.random.default_rng(size)
    a = np.unique(chance.integers(0, 2**63, size, dtype=np.uint64))
    b = np.concatenate([a[: size // 2], chance.integers(0, 2**63, size, dtype=np.uint64)])
    made = sketches([a, a.copy(), np.unique(b)], 150)
    assert (made < np.iinfo(np.int64).max).all()
    assert (made[0] == made[1]).all()
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((made[0] == made[2]).mean() - exact) < 0.2


def test_shingles_lower_only_ascii_letters():
    one, two, three = shingle_sets([b"A B", b"a b", "É b".encode()], 4, WordHasher())
    assert one.tolist() == two.tolist() != three.tolist()
