"""Best-fit packing of tokenised documents by exact-complement hashing.

Pieces of one length are interchangeable, so the packing is decided on counts per length:
a table of at most ``capacity`` rows, whatever the corpus holds. The longest piece left
opens a sequence; its gap is looked up among the lengths, the sums of two and the sums of
three that are still available, and the combination is consumed as often as the counts
allow. Without an exact combination the longest piece that fits is added (best fit) and the
rest of the gap is looked up again. Every step uses up a length, so there are few steps.
Pieces are then numbered within their length by Spark and take the place of their number.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.arrow_runs import numbers, per_process, text_parts
from tallyspark.llm.scratch import saved

CAPACITY = 2048
_END = b"\0\0\0\0"  # id 0 after every document
_REMEMBERED = 1 << 19  # encoded words a Python worker keeps
_LONGEST = 64  # characters of a word worth remembering
_JOINED = 1000  # words encoded as one text
_WORD_END = "</w>"
_PER_SALT, _SALTS = 128, 4096  # pieces of one length numbered together; groups of one length


class Encoder:
    """Token ids of texts as little-endian bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words one after the other, and words are remembered. Plain words, by far the most,
    are encoded many at a time: each ends with a token marked as the end of a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[n for token, n in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._known: dict[str, bytes] = {}

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        found = self._tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {
            word: np.array(one.ids, dtype="<u4").tobytes()
            for word, one in zip(words, found, strict=True)
        }

    def _plain(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone: one call, cut behind every token that ends a word."""
        found = self._tokenizer.encode_batch_fast(
            [" ".join(words[low : low + _JOINED]) for low in range(0, len(words), _JOINED)],
            add_special_tokens=False,
        )
        ids = np.concatenate([np.array(one.ids, dtype="<u4") for one in found])
        cuts = np.nonzero(self._ends[ids])[0] + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            return self._one_by_one(words)
        whole, edges = ids.tobytes(), (4 * cuts).tolist()
        return {
            word: whole[low:high]
            for word, low, high in zip(words, [0, *edges], edges, strict=False)
        }

    def _fresh(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words; a plain word may be capitalised or end in full stops or commas."""
        parts, plain, other = {}, set(), set()
        for word in words:
            base = word.rstrip(".,")
            stem = base.lower() if base.isascii() else base
            # Letters that stay letters in lower case, so no mark can join what follows.
            if stem.isalpha() and stem.lower().isalpha() and len(word) <= _LONGEST:
                parts[word] = (stem, word[len(base) :])
                plain.add(stem)
                other.add(word[len(base) :])
            else:
                other.add(word)
        made = {word: self._known[word] for word in plain | other if word in self._known}
        if missing := sorted(plain - made.keys()):
            made |= self._plain(missing)
        if missing := sorted(other - made.keys()):
            made |= self._one_by_one(missing)
        return made | {word: made[stem] + made[tail] for word, (stem, tail) in parts.items()}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        known = self._known
        found = [list(map(known.get, words)) for words in split]
        fresh = self._fresh(
            {
                word
                for words, ids in zip(split, found, strict=True)
                for word, one in zip(words, ids, strict=True)
                if one is None
            }
        )
        for words, ids in zip(split, found, strict=True):
            try:
                yield b"".join(ids)
            except TypeError:  # a fresh word
                pairs = zip(words, ids, strict=True)
                yield b"".join([fresh[word] if one is None else one for word, one in pairs])
        room = max(0, _REMEMBERED - len(known))
        known.update(islice(((w, i) for w, i in fresh.items() if len(w) <= _LONGEST), room))


def _pieces(tokenizer_path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
        for batch in batches:
            for part in text_parts(batch, 1):
                owner, piece, start, length, crc = [], [], [], [], []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for row, ids in enumerate(encoder.encode(texts)):
                    whole = ids + _END
                    for number, first in enumerate(range(0, len(whole), 4 * capacity)):
                        cut = whole[first : first + 4 * capacity]
                        owner.append(row)
                        piece.append(number)
                        start.append(first // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


class _Available:
    """Counts per length, and for each sum of two lengths a pair that has it."""

    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self._short = np.zeros(capacity + 1, dtype=np.int64)  # shorter of the pair, 0: none
        for total in range(2, capacity + 1):
            self._index(total)

    def _index(self, total: int) -> None:
        """Enter the most even available pair."""
        shorter = np.arange(total // 2, 0, -1)
        usable = (self.left[shorter] > 0) & (self.left[total - shorter] > (2 * shorter == total))
        self._short[total] = shorter[usable.argmax()] if usable.any() else 0

    def _stale(self, totals: np.ndarray) -> np.ndarray:
        """Sums whose pair has been used up; one that never had a pair cannot gain one."""
        short = self._short[totals]
        gone = (self.left[short] < 1) | (self.left[totals - short] <= (2 * short == totals))
        return totals[gone & (short > 0)]

    def exact(self, gap: int, taken: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths with sum ``gap``, available beside those ``taken``."""
        left = self.left

        def free(*lengths: int) -> bool:
            wanted = taken + Counter(lengths)
            return all(left[length] >= wanted[length] for length in lengths)

        if free(gap):
            return (gap,)
        if gap < 2:
            return None
        for total in self._stale(np.array([gap])).tolist():
            self._index(total)
        short = int(self._short[gap])
        if short and free(short, gap - short):
            return short, gap - short
        first = np.arange(gap - 2, 0, -1)
        first = first[left[first] > 0]
        for total in self._stale(gap - first).tolist():
            self._index(total)
        first = first[self._short[gap - first] > 0]
        for length in first.tolist():
            short = int(self._short[gap - length])
            if free(length, short, gap - length - short):
                return length, short, gap - length - short
        return None


@dataclass(frozen=True)
class Slots:
    """Where the pieces of a length go, by their number within the length.

    Entry *i* holds the numbers from ``first[i]`` of length ``length[i]``: ``repeat[i]`` of
    them side by side in each of the sequences from ``sequence[i]``, starting at
    ``offset[i]``. Sorted by length and first number.
    """

    length: np.ndarray
    first: np.ndarray
    repeat: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[Slots, int]:
    """Slots for all pieces and the number of sequences."""
    available = _Available(counts, capacity)
    left = available.left
    used = np.zeros(capacity + 1, dtype=np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    longest = capacity
    while longest:
        if not left[longest]:
            longest -= 1
            continue
        parts = Counter([longest])
        gap = capacity - longest
        while gap:
            found = available.exact(gap, parts)
            if not found:
                fitting = np.nonzero(left[1 : gap + 1])[0][::-1] + 1
                best = next((n for n in fitting.tolist() if left[n] > parts[n]), None)
                if best is None:
                    break
                found = (best,)
            parts.update(found)
            gap -= sum(found)
        times = min(int(left[length]) // repeat for length, repeat in parts.items())
        offset = 0
        for length, repeat in parts.items():
            entries.append((length, int(used[length]), repeat, sequences, offset))
            used[length] += times * repeat
            left[length] -= times * repeat
            offset += length * repeat
        sequences += times
    table = np.array(sorted(entries), dtype=np.int64).reshape(-1, 5)
    return Slots(*(table[:, column].copy() for column in range(5))), sequences


def _placed(slots: Slots):
    """Sequence and offset of each piece from its length and its number."""
    key = slots.length * (1 << 48) + slots.first

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = numbers(batch.column(3)), numbers(batch.column(5))
            entry = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            beyond = rank - slots.first[entry]
            repeat = slots.repeat[entry]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(place) for place in range(5)),
                    pa.array(slots.sequence[entry] + beyond // repeat),
                    pa.array(slots.offset[entry] + (beyond % repeat) * length),
                ],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return run


def _numbered(pieces: DataFrame, counts: Mapping[int, int]) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, by groups so that no length is one task."""
    spark = pieces.sparkSession
    per_length = spark.createDataFrame(
        [(n, max(1, min(_SALTS, -(-count // _PER_SALT)))) for n, count in counts.items()],
        "length long, salts long",
    )
    salted = pieces.join(F.broadcast(per_length), "length").withColumn(
        "salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("salts"))
    )
    earlier = Window.partitionBy("length").orderBy("salt")
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("here"))
        .select("length", "salt", (F.sum("here").over(earlier) - F.col("here")).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    return salted.join(before, ["length", "salt"]).select(
        "id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("before") + F.row_number().over(within) - 1).alias("rank"),
    )


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    ``<id>, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids
    and a 0; null and empty texts are the 0 alone. Only documents above ``capacity`` are cut.
    Repeated rows, and rows without an id, are documents of their own. No rows, no result.
    Other columns are ignored. ``tokenizer_path`` is a ``tokenizers`` file present on every
    executor; its tokenizer must not join tokens across a space or line break.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = saved(
        texts.mapInArrow(_pieces(tokenizer_path, capacity), columns), "pack-pieces"
    ).frame
    counts = {
        row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()
    }  # at most `capacity` rows
    slots, _ = plan(counts, capacity)
    return (
        _numbered(pieces, counts)
        .mapInArrow(_placed(slots), f"{columns}, sequence_id long, offset long")
        .withColumnRenamed("id", id_column)
    )
