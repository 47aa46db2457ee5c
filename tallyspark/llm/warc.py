"""WARC derivatives: linked metadata and plain-text conversion records for responses.

Records are whole WARC 1.1 records in a binary column. A conversion record refers to its
response by record id; a metadata record refers to both and repeats the source's digests,
HTTP status and headers. Ids of derived records follow from the id of the source, so
reruns agree.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.html_blocks import blocks

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_TEXTUAL = ("text/html", "application/xhtml+xml", "text/plain")


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(*names: object) -> str:
    text = " ".join("" if name is None else str(name) for name in names)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def _line(name: str, value: str) -> bytes:
    """A header line; line breaks inside a value would end it and become spaces."""
    return f"{name}: {' '.join(value.split())}\r\n".encode()


def build(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """A record, with block digest and length added."""
    lines = [_line(name, value) for name, value in headers]
    lines.append(_line("WARC-Block-Digest", digest(block)))
    lines.append(_line("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + b"".join(lines) + b"\r\n" + block + _END


def _headers(lines: bytes) -> list[tuple[str, str]]:
    """Name and value per line; folded lines continue the value before."""
    found: list[tuple[str, str]] = []
    for line in lines.split(b"\n"):
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def _split_head(content: bytes) -> tuple[bytes, bytes] | None:
    """What stands before and after the first empty line."""
    found = re.search(rb"\r?\n\r?\n", content)
    return (content[: found.start()], content[found.end() :]) if found else None


def parse(record: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case, the first of repeated ones) and block, or None."""
    parts = _split_head(record or b"")
    if not parts or not parts[0].startswith(b"WARC/"):
        return None
    headers: dict[str, str] = {}
    for name, value in _headers(parts[0].partition(b"\n")[2]):
        headers.setdefault(name.lower(), value)
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(parts[1]) < int(length):
        return None
    return headers, parts[1][: int(length)]


def response(page: object, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A response record for a stored page; a null page has an empty body."""
    body = (html or "").encode()
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        + f"Content-Length: {len(body)}\r\n\r\n".encode()
        + body
    )
    return build(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id("response", page, url)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url or ""),
            ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", digest(body)),
        ],
        http,
    )


def plain_text(body: bytes, content_type: str) -> str:
    """All visible text of a page, a block per line; plain text as it is."""
    named = _CHARSET.search(content_type)
    try:
        text = body.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, ValueError):  # not a character set, or one that cannot replace
        text = body.decode("utf-8", "replace")
    if content_type.partition(";")[0].strip().lower() == "text/plain":
        return text
    return "\n".join(block.text for block in blocks(text))


def derive(record: bytes | None) -> list[tuple[str, str, str, bytes]]:
    """``type, id, id it refers to, record`` of what a response gives rise to.

    A textual response gives a conversion and a metadata record; any other response a
    metadata record that says why there is no conversion. Records of other types and
    broken ones give nothing.
    """
    parsed = parse(record)
    if not parsed or parsed[0].get("warc-type") != "response":
        return []
    headers, block = parsed
    source = headers.get("warc-record-id", "")
    common = [
        ("WARC-Date", headers.get("warc-date", "")),
        ("WARC-Target-URI", headers.get("warc-target-uri", "")),
    ]
    parts = _split_head(block)
    status, fields, body = "", [], b""
    if parts and parts[0].startswith(b"HTTP/"):
        first, _, rest = parts[0].partition(b"\n")
        status = first.decode("utf-8", "replace").strip()
        fields, body = _headers(rest), parts[1]
    kind = next((value for name, value in fields if name.lower() == "content-type"), "")
    code = status.split()[1] if len(status.split()) > 1 else ""
    textual = code == "200" and kind.partition(";")[0].strip().lower() in _TEXTUAL
    made = []
    found = digest(body)
    stated = headers.get("warc-payload-digest", found)
    notes = [
        ("source-record-id", source),
        ("source-block-digest", headers.get("warc-block-digest", digest(block))),
        ("source-payload-digest", stated),
        ("source-payload-intact", "yes" if stated == found else "no"),
        ("http-status", status),
        *((f"http-{name.lower()}", value) for name, value in fields),
    ]
    if textual:
        text = plain_text(body, kind).encode()
        conversion = record_id("conversion", source)
        made.append(
            (
                "conversion",
                conversion,
                source,
                build(
                    [
                        ("WARC-Type", "conversion"),
                        ("WARC-Record-ID", conversion),
                        *common,
                        ("WARC-Refers-To", source),
                        ("Content-Type", "text/plain; charset=utf-8"),
                        ("WARC-Payload-Digest", digest(text)),
                    ],
                    text,
                ),
            )
        )
        notes += [("conversion-record-id", conversion), ("conversion-digest", digest(text))]
    else:
        notes.append(("conversion-skipped", "not a textual response with status 200"))
    metadata = record_id("metadata", source)
    made.append(
        (
            "metadata",
            metadata,
            source,
            build(
                [
                    ("WARC-Type", "metadata"),
                    ("WARC-Record-ID", metadata),
                    *common,
                    ("WARC-Refers-To", source),
                    ("Content-Type", "application/warc-fields"),
                ],
                b"".join(_line(name, value) for name, value in notes),
            ),
        )
    )
    return made


def _responses(date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(place).to_pylist() for place in range(3)]
            made = [response(*row, date) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.binary())], names=["id", "record"]
            )

    return run


def responses(
    pages: DataFrame,
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    date: str = DATE,
) -> DataFrame:
    """``<id>, record``: a response record per row. Null URLs and pages are empty."""
    rows = pages.select(F.col(id_column).alias("id"), url_column, html_column)
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_responses(date), f"id {kind}, record binary")
    return made.withColumnRenamed("id", id_column)


def _derived(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("record_type", "record_id", "refers_to", "record")
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            owner, made = [], []
            for row, record in enumerate(part.column(1).to_pylist()):
                found = derive(record)
                owner += [row] * len(found)
                made += found
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(owner, pa.int64())),
                    *(pa.array([one[at] for one in made], kind) for at, kind in enumerate(kinds)),
                ],
                names=["id", *names],
            )


def derivatives(
    records: DataFrame, *, id_column: str = "page_id", record_column: str = "record"
) -> DataFrame:
    """``<id>, record_type, record_id, refers_to, record`` for all responses.

    Null, empty, broken and other records give no rows; repeated responses give repeated
    rows. Other columns are ignored.
    """
    rows = records.select(
        F.col(id_column).alias("id"), F.col(record_column).alias("record")
    )
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(
        _derived,
        f"id {kind}, record_type string, record_id string, refers_to string, record binary",
    )
    return made.withColumnRenamed("id", id_column)


def members(content: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or with each record its own gzip member."""
    if content[:2] == b"\x1f\x8b":
        plain = []
        while content[:2] == b"\x1f\x8b":
            reader = zlib.decompressobj(31)
            plain.append(reader.decompress(content) + reader.flush())
            content = reader.unused_data
        content = b"".join(plain)
    at = content.find(b"WARC/")
    while at >= 0:
        head = re.compile(rb"\r?\n\r?\n").search(content, at)
        if not head:
            return
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)", content[at : head.start()])
        end = head.end() + int(length[1]) if length else head.end()
        yield content[at:end] + _END
        at = content.find(b"WARC/", end)


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            held: list[bytes] = []
            for record in members(content):
                held.append(record)
                if len(held) == 500:
                    yield _batch(path, held)
                    held = []
            if held:
                yield _batch(path, held)


def _batch(path: str, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(records), pa.string()), pa.array(records, pa.binary())],
        names=["path", "record"],
    )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``path, record`` of WARC files (below 2 GB each) at a path that Spark can read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(_members, "path string, record binary")
