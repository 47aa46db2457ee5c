"""Main text of web pages: a suffix array of the token streams of each host, and their marks.

The token streams of all pages of a host go into one suffix array (``suffix_index``). What
two pages share for at least ``LONG`` tokens is a repeated substring; token runs that such
substrings cover are boilerplate candidates, the other runs are unique. A page's text are its
runs, checked exactly against what the page itself says of them:

* Furniture (navigation, adverts, forms, ...) goes, unique or not.
* Where no article is marked, or marked ones do not hold the bulk of the page, covered runs
  go and unique runs stay. Articles may quote: what other pages have in their marked article
  covers nothing here, nor does what fewer pages have than ``SHARE`` per cent of the host's
  pages without such marks (two pages at least).
* In a marked article a covered run stays, as articles share passages, unless the articles of
  ``MOST`` per cent of the host's pages (``MANY`` pages at least) have it: then it is a notice.
* Beside a marked article unique runs of ``LONG`` tokens stay, if the host has other pages to
  compare with; covered and shorter runs go.

Pages with near-equal main texts (``COPY`` per cent of their runs of ``LONG`` tokens) count
as one page on hosts where covered runs go, so a print view does not turn an article into
boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import suffix_index
from tallyspark.llm.arrow_runs import text_parts
from tallyspark.llm.html_blocks import CHROME, LOOSE, blocks, main_part
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.scratch import saved
from tallyspark.llm.suffix_index import LONG

COPY = 60  # per cent of such runs that near copies share
SHARE = 25  # per cent of a host's open pages that make boilerplate
MOST, MANY = 75, 8  # per cent of a host's pages, and pages, that make a notice in articles
_SKETCH = {"bands": 40, "rows": 3}  # a pair that shares 60 per cent is missed by 6e-5
_FURNITURE, _MAIN, _BESIDE, _OPEN = b"C", suffix_index.INNER, b"B", b"L"  # kinds of a line

_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)


def host_of(url: str | None) -> str:
    """Lower-case host of a URL; empty if there is none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def lines_of(page: str | None) -> tuple[str, bytes]:
    """The blocks of a page, a line each, and the kind of each line."""
    made = blocks(page)
    main = main_part(made)
    other = _OPEN if main == LOOSE else _BESIDE
    kinds = (
        _FURNITURE if b.part == CHROME else _MAIN if b.part == main != LOOSE else other for b in made
    )
    return "\n".join(block.text for block in made), b"".join(kinds)


def _covered(starts: list[int] | None, total: int) -> np.ndarray:
    covered = np.zeros(total, dtype=bool)
    width = min(LONG, total)
    for at in starts or ():
        covered[at : at + width] = True
    return covered


def _runs(flags: np.ndarray) -> list[list[int]]:
    """Bounds of the runs that are set."""
    return np.nonzero(np.diff(flags, prepend=False, append=False))[0].reshape(-1, 2).tolist()


def _without(words: list[str], covered: np.ndarray) -> str:
    """A block without its covered runs.

    A run is cut if it has ``LONG`` tokens in the block or is all of it; a shorter one only
    reaches over from the next block.
    """
    kept = np.ones(len(words), dtype=bool)
    for low, high in _runs(covered):
        if high - low >= min(LONG, len(words)):
            kept[low:high] = False
    return " ".join(words[at] for at in np.nonzero(kept)[0].tolist())


def _unique(words: list[str], covered: np.ndarray) -> str:
    """The uncovered runs of ``LONG`` tokens."""
    long_runs = (words[low:high] for low, high in _runs(~covered) if high - low >= LONG)
    return " ".join(" ".join(run) for run in long_runs)


def kept_text(
    text: str,
    kinds: bytes,
    repeated: list[int] | None,
    anywhere: list[int] | None,
    notices: list[int] | None,
    pages: int | None,
) -> str:
    """The main text from a page's lines and where its repeated substrings begin.

    ``repeated`` ones stand outside the articles of enough pages, ``anywhere`` on any two
    pages, ``notices`` in most articles. ``pages`` is the host's number of pages, null without
    lines that it decides on. A page of nothing but repeated runs is a copy of
    another page, not boilerplate, and keeps them; so does an article that is mostly notices.
    """
    if pages is None:  # nothing repeated, nothing beside an article
        kept = _MAIN + _OPEN
        return "\n".join(line for line, kind in zip(text.split("\n"), kinds) if kind in kept)
    lines = [line.split(" ") for line in text.split("\n")] if text else []
    ends = np.cumsum([0, *map(len, lines)]).tolist()
    starts = {_OPEN: repeated, _BESIDE: anywhere, _MAIN: notices}
    covered = {kind[0]: _covered(own, ends[-1]) for kind, own in starts.items()}
    main = np.repeat(np.frombuffer(kinds, np.uint8) == _MAIN[0], np.diff(ends))
    if 100 * np.count_nonzero(covered[_MAIN[0]] & main) > (100 - COPY) * np.count_nonzero(main):
        covered[_MAIN[0]][:] = False
    candidates, unique = [], []
    for place, words in enumerate(lines):
        kind = kinds[place]
        if kind == _FURNITURE[0]:
            continue
        own = covered[kind][ends[place] : ends[place + 1]]
        if kind == _BESIDE[0]:
            candidates.append("")
            unique.append(_unique(words, own) if pages > 1 else "")
        else:
            candidates.append(" ".join(words))
            unique.append(_without(words, own))
    return "\n".join(filter(None, unique)) or "\n".join(filter(None, candidates))


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, id, url, page, host, loose, lines, text``: every page, parsed once.

    ``row`` is a page's own number; ``loose`` are pages of which covered runs may go.
    """
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in text_parts(batch, 2):
            found = [lines_of(page) for page in part.column(2).to_pylist()]
            loose = []
            for text, kinds in found:
                beside = any(
                    kind == _BESIDE[0] and line.count(" ") >= LONG - 1
                    for line, kind in zip(text.split("\n"), kinds)
                )
                loose.append(_OPEN in kinds or beside)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + part.num_rows)),
                    part.column(0),
                    part.column(1),
                    part.column(3),
                    pa.array([host_of(url) for url in part.column(1).to_pylist()], pa.string()),
                    pa.array(loose, pa.bool_()),
                    pa.array([kinds for _, kinds in found], pa.binary()),
                    pa.array([text for text, _ in found], pa.string()),
                ],
                names=["row", "id", "url", "page", "group", "loose", "lines", "text"],
            )
            row += part.num_rows


def _mains(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``page, main``: each page's main text, or what may be it."""
    for batch in batches:
        texts = []
        for kinds, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = (line for line, kind in zip(text.split("\n"), kinds) if kind in _OPEN + _MAIN)
            texts.append("\n".join(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string())], names=["page", "main"]
        )


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The main text of every page."""
    for batch in batches:
        for part in text_parts(batch, 2):
            columns = [part.column(place).to_pylist() for place in range(2, 8)]
            texts = [kept_text(*page) for page in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string())],
                names=["id", "url", "text"],
            )


def _once(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, group, same``: what counts as one page; ``group, size, open``: such pages of a host.

    ``open`` counts the pages that mark no article.
    """
    is_open = F.locate(_OPEN.decode(), F.col("lines").cast("string")) > 0
    pages = parsed.select("row", "group", "page", is_open.alias("open"))
    hosts = saved(pages.where("open").select("group").distinct(), "pages-hosts").frame
    if hosts.isEmpty():
        named = pages.withColumnRenamed("page", "same")
    else:
        mains = saved(
            parsed.join(hosts, "group", "left_semi")
            .select("page", "lines", "text")
            .mapInArrow(_mains, "page long, main string"),
            "pages-main",
        ).frame
        merged = (
            near_duplicates(
                mains, id_column="page", text_column="main", words=LONG, percent=COPY, **_SKETCH
            )
            .groupBy("page")
            .agg(F.min("component_id").alias("copies"))
        )
        named = saved(
            pages.join(merged, "page", "left").select(
                "row", "group", F.coalesce("copies", "page").alias("same"), "open"
            ),
            "pages-once",
        ).frame
    sizes = (
        named.groupBy("group", "same")
        .agg(F.max("open").alias("open"))
        .groupBy("group")
        .agg(F.count("*").alias("size"), F.count_if("open").alias("open"))
    )
    # Written, so that few hosts are broadcast and a hot one is not gathered in a task.
    return named.select("row", "group", "same"), saved(sizes, "pages-sizes").frame


def extract(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """``<id>, <url>, text, n_chars`` for every row of ``pages``.

    Blocks are joined in page order by line breaks. Null and empty pages, and pages without
    main text, have an empty text. A null or odd URL has the empty host. Rows that repeat an
    id are one page when repeated substrings are counted and each gets its own text. No
    rows, no result. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    page = F.when(F.col("id").isNull(), F.xxhash64("url", "html")).otherwise(F.xxhash64("id"))
    parsed = saved(
        rows.withColumn("page", page).mapInArrow(
            _parsed,
            f"row long, id {kind}, url string, page long, group string, loose boolean, "
            "lines binary, text string",
        ),
        "pages-parsed",
    ).frame
    once, sizes = _once(parsed)
    numbered = once.join(sizes, "group")
    enough = (F.col("texts") >= MANY) & (100 * F.col("texts") >= MOST * F.col("size"))
    chosen = saved(
        suffix_index.recurring_digits(parsed)
        .join(numbered, "row")
        .where(F.col("loose") | enough)
        .groupBy("row", "same", "size", "open")
        .agg(F.collect_list("digit").alias("digits")),  # at most a page's own
        "pages-chosen",
    ).frame
    found = suffix_index.repeats(parsed.join(chosen.select("row", "same", "digits"), "row"))
    repeated = (F.col("outside") > 1) & (100 * F.col("outside") >= SHARE * F.col("open"))
    most = (F.col("inside") >= MANY) & (100 * F.col("inside") >= MOST * F.col("size"))
    decided = (
        found.join(chosen.select("row", "size", "open"), "row")
        .select(
            "row",
            F.when(repeated, F.col("at")).alias("repeated"),
            F.col("at").alias("anywhere"),
            F.when(most, F.col("at")).alias("notices"),
            F.col("size").alias("pages"),
        )
        .unionByName(
            numbered.join(parsed.where("loose").select("row"), "row").select(
                "row", F.col("size").alias("pages")
            ),
            allowMissingColumns=True,
        )
        .groupBy("row")
        .agg(
            *(F.collect_list(name).alias(name) for name in ("repeated", "anywhere", "notices")),
            F.max("pages").alias("pages"),
        )
    )
    texts = (
        parsed.select("row", "id", "url", "text", "lines")
        .join(saved(decided, "pages-decided").frame, "row", "left")
        .select("id", "url", "text", "lines", "repeated", "anywhere", "notices", "pages")
        .mapInArrow(_texts, f"id {kind}, url string, text string")
    )
    return texts.select(
        F.col("id").alias(id_column),
        F.col("url").alias(url_column),
        "text",
        F.length("text").cast("bigint").alias("n_chars"),
    )
