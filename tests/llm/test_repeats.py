import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import repeats
from tallyspark.llm.radix import equal_groups

SCHEMA = "doc_id long, text string, doc int, mark string, start string, piece string"


def table(spark, rows):
    return spark.createDataFrame([(i, text, 1, "x", "y", "z") for i, text in rows], SCHEMA)


def brute(rows, depth):
    first = {}
    texts = [(i, (text or "").encode()) for i, text in rows]
    for i, text in texts:
        for at in range(len(text) - depth + 1) if i is not None else ():
            window = text[at : at + depth]
            first[window] = min(first.get(window, i), i)
    found = []
    for i, text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - depth + 1) if i is not None else ():
            if first[text[at : at + depth]] < i:
                gone[at : at + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(1 for at in range(len(gone)) if gone[at] and (not at or not gone[at - 1]))
        found.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def result(frame):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(row) for row in frame.select(*names).collect()), key=repr)


def mixed_rows(seed):
    chance = random.Random(seed)
    words = ["".join(chance.choices("abcdeé中", k=chance.randint(1, 9))) for _ in range(300)]
    passage = " ".join(chance.choices(words, k=30))
    base = chance.choices(words, k=120)
    rows = []
    for n in range(160):
        own = chance.choices(words, k=chance.randint(0, 90))
        kind = n % 4
        if kind == 0:  # one passage in a quarter of all documents, whole or cut
            low = chance.randint(0, 60)
            own.insert(len(own) // 2, passage[low : low + chance.randint(40, 200)])
        if kind == 1:  # near copies
            own = list(base)
            for _ in range(chance.randint(0, 5)):
                own[chance.randrange(120)] = chance.choice(words)
        rows.append((chance.randint(-50, 10**12), " ".join(own)))
    rows += [(10**13 + n, rows[n][1]) for n in range(20)]  # copies
    rows += [(7, passage), (7, passage), (7, passage + " " + passage), (None, passage), (None, None)]
    rows += [(8, None), (9, ""), (10, "short"), (11, "x" * 49), (12, "x" * 50), (13, "x" * 5000), (14, "ab" * 3000)]
    rows += [(15, "x" * 51 + "y" + "ab" * 40), (16, "\0" * 120), (17, "\0" * 60)]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # common digits, wide digits, split texts and many fragments
        for name, value in (("_COMMON", 5), ("_MANY", 3), ("_SEGMENT", 700), ("_FORWARDED", 50)):
            monkeypatch.setattr(repeats, name, value)
    rows = mixed_rows(small)
    assert result(repeats.digest(table(spark, rows).repartition(5))) == brute(rows, 50)


def test_other_depths(spark):
    rows = [(n, f"shared words here {n}") for n in range(5)] + [(9, "rds h"), (10, "ds he")]
    for depth in (1, 3, 8):
        assert result(repeats.digest(table(spark, rows), depth=depth)) == brute(rows, depth)


def test_spans_and_kept_bytes(spark):
    text = "p" * 60
    rows = [(1, "A" + text + "B"), (2, "one " + text + " two")]
    row = repeats.remove_repeats(table(spark, rows)).where("doc_id = 2").first()
    assert [tuple(span) for span in row["spans"]] == [(4, 64)] and bytes(row["kept"]) == b"one  two"


def test_empty_table(spark):
    assert repeats.digest(table(spark, [])).collect() == []


def test_equal_groups_drop_rows_that_are_alone():
    digits = [np.array(d, np.uint64) for d in ([5, 5, 1, 5, 1], [2, 3, 2, 2, 9], [0, 0, 0, 0, 0])]
    rows, group = equal_groups(digits)
    assert rows.tolist() == [0, 3] and group[0] == group[1]
