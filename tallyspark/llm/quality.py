"""Quality rules: counts with fixed limits, then a calibrated n-gram model.

The model is a logistic regression on hashed word n-grams and character n-grams of the
whole text, as relative frequencies. It is trained on a bounded sample of labelled rows,
calibrated on rows it was not trained on (Platt scaling), and scored in Arrow batches. The
driver sees the sample as feature counts, at most ``_SIZE`` a row however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import binaries, text_parts
from tallyspark.llm.shingles import WordHasher, windows

LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
KEEP = 0.5  # probability of good quality that is kept
SAMPLE_ROWS = 2400  # labelled rows the model is trained and calibrated on, about

_BITS = 14  # of a hashed feature, in each of the groups
_GROUPS = (("word", 1), ("word", 2), ("char", 3), ("char", 4))
_SIZE = len(_GROUPS) << _BITS
_BLOCK = 1 << 20  # entries of sample rows that a training step reads at a time
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rule_counts(text: bytes | None, hasher: WordHasher) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    seen, repeated_lines = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            if line in seen:
                repeated_lines += 1
            seen.add(line)
    found = windows(hasher.hashes(words), WINDOW)
    covered = 0
    if len(found):
        order = np.argsort(found)
        again = found[order][1:] == found[order][:-1]
        twice = np.zeros(len(found), dtype=bool)
        twice[order[1:][again]] = True
        twice[order[:-1][again]] = True
        change = np.zeros(len(words) + 1, dtype=np.int64)
        starts = np.nonzero(twice)[0]
        change[starts] += 1
        change[starts + WINDOW] -= 1
        covered = int((np.cumsum(change) > 0).sum())
    return (
        len(words),
        len(text.translate(None, _SPACE).decode()),
        len(text) - len(text.translate(None, _SYMBOLS)),
        repeated_lines,
        covered,
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED_PERCENT * n_words)


def features(text: bytes, hasher: WordHasher) -> list[np.ndarray]:
    """Hashed features of each group, one entry per occurrence."""
    shift = np.uint64(64 - _BITS)
    hashes = hasher.hashes(text.split())
    letters = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    made = []
    for group, (kind, width) in enumerate(_GROUPS):
        if kind == "word":
            rolled = windows(hashes, width)
            if width > 1:  # a word beside itself is one feature, whatever the word
                rolled = np.where(hashes[1:] == hashes[:-1], np.uint64(0), rolled)
        else:
            count = max(0, len(letters) - width + 1)
            rolled = letters[:count].copy()
            for place in range(1, width):
                rolled = (rolled << np.uint64(9)) + letters[place : place + count]
            rolled *= _ODD
        made.append((rolled >> shift).astype(np.int64) + (group << _BITS))
    return made


@dataclass(frozen=True)
class Model:
    """Weights of the features, and the calibration of their sum."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, text: bytes, hasher: WordHasher) -> float:
        total = self.bias
        for group in features(text, hasher):
            if len(group):
                total += float(self.weights[group].mean())
        return total

    def probability(self, text: bytes | None, hasher: WordHasher) -> float:
        """Of good quality."""
        z = self.slope * self.raw(text or b"", hasher) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


ALWAYS = Model(np.zeros(_SIZE), 0.0, 0.0, 30.0)  # without labels of both kinds


def packed_features(text: bytes, hasher: WordHasher) -> tuple[bytes, bytes]:
    """The features of a whole text (2 bytes each) and how often they occur (4 bytes each)."""
    columns, counts = [], []
    for group in features(text, hasher):
        if len(group):
            low = int(group.min() >> _BITS) << _BITS
            found = np.bincount(group - low)
            own = np.nonzero(found)[0]
            columns.append((own + low).astype("<u2"))
            counts.append(found[own].astype("<u4"))
    return (
        np.concatenate([np.empty(0, "<u2"), *columns]).tobytes(),
        np.concatenate([np.empty(0, "<u4"), *counts]).tobytes(),
    )


class _Rows:
    """Sparse rows of relative frequencies, 6 bytes an entry, read a block of rows at a time."""

    def __init__(self, packed: Iterable[tuple[bytes, bytes]]) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        columns, values, lengths, size = [], [], [], 0

        def close() -> None:
            self.blocks.append(
                (
                    np.concatenate([np.empty(0, "<u2"), *columns]),
                    np.concatenate([np.empty(0, np.float32), *values]),
                    np.array(lengths, dtype=np.int64),
                )
            )

        for own, counted in packed:
            column, counts = np.frombuffer(own, "<u2"), np.frombuffer(counted, "<u4")
            group = column >> _BITS
            totals = np.bincount(group, weights=counts, minlength=len(_GROUPS))
            columns.append(column)
            values.append((counts / totals[group]).astype(np.float32))
            lengths.append(len(column))
            size += len(column)
            if size >= _BLOCK:
                close()
                columns, values, lengths, size = [], [], [], 0
        if lengths:
            close()
        self.count = sum(len(lengths) for *_, lengths in self.blocks)

    def times(self, weights: np.ndarray) -> np.ndarray:
        made = [np.empty(0)]
        for column, value, lengths in self.blocks:
            row = np.repeat(np.arange(len(lengths)), lengths)
            made.append(np.bincount(row, weights=value * weights[column], minlength=len(lengths)))
        return np.concatenate(made)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        total, at = np.zeros(_SIZE), 0
        for column, value, lengths in self.blocks:
            terms = value * np.repeat(error[at : at + len(lengths)], lengths)
            total += np.bincount(column, weights=terms, minlength=_SIZE)
            at += len(lengths)
        return total


def train(texts: list[bytes], good: list[bool], steps: int = 60) -> Model:
    """``fit`` on the features of the texts."""
    hasher = WordHasher()
    return fit([packed_features(text, hasher) for text in texts], good, steps)


def fit(packed: list[tuple[bytes, bytes]], good: list[bool], steps: int = 60) -> Model:
    """Adaptive gradient steps on four fifths of the rows, Platt scaling on the rest.

    Labels of one kind only give a model that keeps everything.
    """
    label = np.array(good, dtype=float)
    held = np.arange(len(packed)) % 5 == 4
    if min(label[~held].sum(), (1 - label[~held]).sum()) < 1:
        return ALWAYS
    rows = _Rows(row for row, own in zip(packed, held, strict=True) if not own)
    truth = label[~held]
    bias = float(np.log(truth.sum() / (1 - truth).sum()))
    weights, squares = np.zeros(_SIZE), np.full(_SIZE, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(rows.times(weights) + bias)))
        slope = rows.gradient(p - truth) / rows.count + 1e-7 * weights
        squares += slope**2
        weights -= 2.0 * slope / np.sqrt(squares)
        bias -= 0.5 * float((p - truth).mean())
    checked = _Rows(row for row, own in zip(packed, held, strict=True) if own)
    raw = bias + checked.times(weights)
    return Model(weights.astype(np.float32), bias, *_platt(raw, label[held]))


def _platt(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated log odds, with Platt's smoothed targets."""
    good, bad = label.sum(), (1 - label).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope = x.T @ (p - target) + 1e-3 * (at - [1.0, 0.0])
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        at = at - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 0.0)), float(at[1])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``place, good, columns, counts`` of ``text, place, good``."""
    hasher = WordHasher()
    for batch in batches:
        for part in text_parts(batch, 0):
            made = [packed_features(text, hasher) for text in binaries(part.column(0))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1),
                    part.column(2),
                    pa.array([columns for columns, _ in made], pa.binary()),
                    pa.array([counts for _, counts in made], pa.binary()),
                ],
                names=["place", "good", "columns", "counts"],
            )


def learn(rows: DataFrame, known: DataFrame) -> Model:
    """A model from ``id, text`` and ``id, good``, of a sample of about ``SAMPLE_ROWS`` rows.

    A hash of id and text thins the distinct rows, whatever the table holds and however
    long the texts are; only the feature counts of the sample reach the driver. The hash is
    made in front of the join, so no text but the sample's is shuffled.
    """
    placed = (
        rows.where("text is not null")
        .withColumn("place", F.xxhash64("id", "text"))
        .join(known.where("good is not null"), "id")
    )
    distinct = placed.select("place", "good").distinct().count()
    if not distinct:
        return ALWAYS
    share = min(1.0, SAMPLE_ROWS / distinct)
    found = (
        placed.where(F.pmod("place", F.lit(1 << 20)) < (1 << 20) * share)
        .dropDuplicates(["place", "good"])
        .select("text", "place", "good")
        .mapInArrow(_packed, "place long, good boolean, columns binary, counts binary")
        .collect()
    )
    found.sort(key=lambda row: (row["place"], row["good"]))
    return fit([(row["columns"], row["counts"]) for row in found], [row["good"] for row in found])


def _judged(model: Model, keep: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part in text_parts(batch, 0):
                texts = binaries(part.column(0))
                counts = np.array(
                    [rule_counts(text, hasher) for text in texts], dtype=np.int64
                ).reshape(-1, 5)
                failed = base_failed(counts[:, 0], counts[:, 4])
                good = np.array([model.probability(text, hasher) for text in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(place) for place in range(1, part.num_columns)),
                        *(pa.array(counts[:, place]) for place in range(5)),
                        pa.array(failed),
                        pa.array(~failed & (good >= keep)),
                        pa.array(good),
                    ],
                    names=[*part.schema.names[1:], *_RESULT],
                )

    return run


_RESULT = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "good": "double",
}


def judge(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: float = KEEP,
) -> DataFrame:
    """``<id>``, the counts, ``base_failed``, ``kept`` and ``good`` for every row.

    ``labels`` has the id and ``quality`` (0, 1; null counts for nothing). ``good`` is the
    calibrated probability of quality 1. Null and empty texts have no words and fail.
    Repeated rows are judged alike. Without labels of both kinds the rules alone decide.
    Other columns are ignored.
    """
    rows = documents.select(
        F.col(text_column).alias("text"), F.col(id_column).alias("id")
    )
    known = labels.select(
        F.col(id_column).alias("id"), (F.col("quality") == 1).alias("good")
    )
    model = learn(rows, known)
    kind = rows.schema["id"].dataType.simpleString()
    result = ", ".join(f"{name} {of}" for name, of in _RESULT.items())
    return rows.mapInArrow(_judged(model, keep), f"id {kind}, {result}").withColumnRenamed(
        "id", id_column
    )
