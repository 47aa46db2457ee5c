"""Language of a text by compression: the dictionary that makes it smallest wins.

Each language has a raw-content zstandard dictionary of sample texts. A text is cut into
blocks, each block is compressed once per language, and the sizes are summed, so a text of
any length is judged as a whole in bounded memory. One dictionary saves too few bytes to
tell short texts apart: where the margin between the best two languages is narrow, the text
is compressed with each of several parts of the dictionaries and those sizes are added. A
margin that is narrow even then is a rejection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.arrow_runs import text_parts

UNKNOWN = "und"
DICTIONARY_BYTES = 64 << 10  # per language
SAMPLE_ROWS = 400  # labelled rows per language that a dictionary is made of, at most
SHARDS = 8  # of a dictionary, each used alone for a second opinion
LEVEL = 6
BLOCK = 16 << 10
CLOSE = 0.02  # of the second size; what is closer gets the second opinion
MARGIN = 0.002  # of the second size; what is still closer is rejected
_PER_BYTE = 0.5  # evidence of one byte saved


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """A dictionary per language from ``text, language``, a bounded sample of it.

    A hash of the text thins a language to about twice ``SAMPLE_ROWS`` different texts,
    whatever the table holds; copies of a text count once, whatever their keys. The first
    ``SAMPLE_ROWS`` of them share ``DICTIONARY_BYTES``: of each a window at a place that a
    hash chooses is read to the driver, whole texts where a language has few. Other columns
    are ignored.
    """
    usable = labelled.where("language is not null and text is not null").select(
        "language", "text", F.xxhash64("text").alias("place")
    )
    known = (
        usable.groupBy("language")
        .agg(F.count("*").alias("rows"), F.approx_count_distinct("place", 0.02).alias("texts"))
        .collect()
    )
    counts = {row["language"]: row["rows"] for row in known}
    if not counts:
        return {}

    def per_language(of: Callable[[int], float]) -> Column:
        pairs = ((row["language"], of(max(1, row["texts"]))) for row in known)
        return F.create_map(*(F.lit(value) for pair in pairs for value in pair))[F.col("language")]

    share = per_language(lambda texts: min(1.0, 2 * SAMPLE_ROWS / texts))
    window = per_language(lambda texts: DICTIONARY_BYTES // min(texts, SAMPLE_ROWS))
    draw = F.pmod("place", F.lit(1 << 20)) / float(1 << 20)
    starts = F.greatest(F.length("text") - window + 1, F.lit(1))
    start = (F.pmod(F.xxhash64("place"), starts) + 1).cast("int")
    turn = F.row_number().over(Window.partitionBy("language").orderBy("draw", "place"))
    rows = (
        usable.where(draw < share)
        .withColumn("text", F.substr("text", start, window))
        .groupBy("language", "place")
        .agg(F.min("text").alias("text"))
        .withColumn("draw", draw)
        .withColumn("turn", turn)
        .where(F.col("turn") <= SAMPLE_ROWS)
        .select("language", "turn", "text")
        .collect()
    )
    rows.sort(key=lambda row: (row["language"], row["turn"]))
    # The most frequent language comes first and wins a draw.
    frequent = sorted(counts, key=lambda language: (-counts[language], language))
    texts: dict[str, list[str]] = {language: [] for language in frequent}
    for row in rows:
        texts[row["language"]].append(row["text"])
    return {language: content for language, own in texts.items() if (content := _joined(own))}


def _joined(texts: list[str]) -> bytes:
    """Lines of lower-case text within ``DICTIONARY_BYTES``; short ones leave room to longer ones."""
    lines = [text.lower().encode() for text in texts]
    left, room = DICTIONARY_BYTES, {}
    for turn, place in enumerate(sorted(range(len(lines)), key=lambda at: len(lines[at]))):
        room[place] = min(len(lines[place]), left // (len(lines) - turn) - 1)
        left -= room[place] + 1
    cut = (line[: room[at]].decode(errors="ignore") for at, line in enumerate(lines))
    return "\n".join(cut).encode()


def _compressor(content: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False
    )


class Classifier:
    def __init__(self, dictionaries: Mapping[str, bytes]) -> None:
        self.languages = list(dictionaries)
        self._whole = [[_compressor(content)] for content in dictionaries.values()]
        self._shards = [
            [
                _compressor(content[low : low + -(-len(content) // SHARDS)])
                for low in range(0, len(content), -(-len(content) // SHARDS))
            ]
            for content in dictionaries.values()
        ]

    @staticmethod
    def _judge(blocks: list[bytes], panels: list) -> tuple[int, float, np.ndarray]:
        """Best language, its relative margin to the second, mean sizes."""
        sizes = np.array(
            [
                sum(len(one.compress(block)) for one in panel for block in blocks) / len(panel)
                for panel in panels
            ]
        )
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = float((rest.min() - sizes[best]) / rest.min()) if len(rest) else 1.0
        return best, margin, sizes

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, confidence (0 to 1) and relative margin to the second language."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        whole = text.lower().encode()
        blocks = [whole[low : low + BLOCK] for low in range(0, len(whole), BLOCK)]
        best, margin, sizes = self._judge(blocks, self._whole)
        if margin < CLOSE:
            best, margin, sizes = self._judge(blocks, self._shards)
        score = 1.0 / float(np.exp(-_PER_BYTE * (sizes - sizes[best])).sum())
        return self.languages[best], score, margin


def _classified(dictionaries: Mapping[str, bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            for part in text_parts(batch, 0):
                found = [classifier.classify(text) for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(place) for place in range(1, part.num_columns)),
                        pa.array([one[0] for one in found], pa.string()),
                        pa.array([one[1] for one in found], pa.float64()),
                        pa.array([one[2] for one in found], pa.float64()),
                    ],
                    names=[*part.schema.names[1:], "__language", "__score", "__margin"],
                )

    return run


def identify(
    rows: DataFrame, dictionaries: Mapping[str, bytes], text_column: str = "text"
) -> DataFrame:
    """``rows`` with ``__language, __score, __margin``.

    Null texts and texts without a letter are ``und`` with score and margin 0, as is
    everything if no language was learned. Other columns pass through.
    """
    made = (("__language", T.StringType()), ("__score", T.DoubleType()), ("__margin", T.DoubleType()))
    shown = rows.select(F.col(text_column).alias("__text"), *(f"`{name}`" for name in rows.columns))
    return shown.mapInArrow(
        _classified(dictionaries),
        T.StructType([*rows.schema.fields, *(T.StructField(*field) for field in made)]),
    )


def rejected(margin: float = MARGIN):
    """Rows of ``identify`` whose language cannot be told."""
    return (F.col("__language") == UNKNOWN) | (F.col("__margin") < margin)


def held_out(key: Column) -> Column:
    """Rows that training must not see: crc32 of the key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
