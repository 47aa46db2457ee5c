"""From a raw extract to a published generation.

One pass over the CSV writes the table, counts every quality rule and takes the
fingerprint of exactly the rows it read; the global statistics come from the
narrow table just written. The pass has no shuffle, so a lost executor repeats
only its own files and no row is counted twice.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.contract import (
    ANALYTIC_COLUMNS,
    RAW_COLUMNS,
    REASONS,
    SCHEMA_VERSION,
    STATISTIC_COLUMNS,
    TARGET_HEADER,
)
from tallyspark.errors import IngestError
from tallyspark.functions.fingerprint import (
    fingerprint,
    fingerprint_counters,
    fingerprint_text,
    row_text,
)
from tallyspark.functions.methods import new_method
from tallyspark.operators.checks import dataset_checks
from tallyspark.operators.normalize import analytic_projection, normalize
from tallyspark.operators.quality import INVALID, observed
from tallyspark.operators.statistics import seven_statistics
from tallyspark.sources.generations import (
    MANIFEST_SCHEMA,
    QUALITY_SCHEMA,
    SUMMARY_SCHEMA,
    folder_listing,
    forget_older,
    generation_path,
    latest_manifest,
    publish_generation,
    read_sales,
    remove_generation,
    write_rows,
    write_sales,
)
from tallyspark.sources.sales_csv import (
    MALFORMED,
    REPLACEMENT,
    damaged_lines,
    read_sales_csv,
    source_listing,
)

DONE = "procesado"
UNCHANGED = "sin_cambios"
POLICY = (
    "A row that breaks any rule is discarded once and counted under every rule it breaks. "
    "No personal value is kept."
)
_LISTING = ("source_files", "source_bytes", "source_changed_us", "source_listing")
_DIGEST, _TEXT, _SUSPECT = "__digest", "__text", "__suspect"


@dataclass(frozen=True)
class IngestResult:
    status: str
    generation_id: str
    valid_rows: int
    discarded_rows: int
    source_fingerprint: str


def _unchanged(
    spark: SparkSession, root: str, source: str, listing, manifest, options: dict
) -> str | None:
    """Fingerprint of the source if it could be compared with the latest generation.

    Other reader options may read other rows, so they count as a change.
    """
    if any(manifest[name] != listing[name] for name in _LISTING) or manifest["source"] != source:
        return None
    if any(manifest[name] != value for name, value in options.items()):
        return None
    if dataset_checks(spark, root, manifest).where(~F.col("ok")).limit(1).count():
        return None
    rows = read_sales_csv(spark, source, multi_line=options["multi_line"])
    return fingerprint_text(fingerprint(rows, RAW_COLUMNS).first())


def needs_ingest(
    spark: SparkSession,
    source: str,
    root: str,
    *,
    on_malformed: str = "fail",
    multi_line: bool = False,
) -> bool:
    """False if the latest generation is coherent and came from this very source.

    The reader options are those ``ingest`` would be called with.
    """
    options = {"on_malformed": on_malformed, "multi_line": multi_line}
    manifest = latest_manifest(spark, root)
    if manifest is None:
        return True
    seen = _unchanged(spark, root, source, source_listing(spark, source), manifest, options)
    return seen is None or seen != manifest["source_fingerprint"]


def ingest(
    spark: SparkSession,
    source: str,
    root: str,
    *,
    force: bool = False,
    on_malformed: str = "fail",
    multi_line: bool = False,
) -> IngestResult:
    """Publish ``source`` as a new generation under ``root``, unless it is unchanged.

    ``on_malformed``: ``fail`` refuses a source with lines of too few or too many
    fields or with a contract column that is not UTF-8; ``null`` pads or cuts them, puts
    U+FFFD for such bytes, and leaves the verdict to the rules.
    """
    if on_malformed not in ("fail", "null"):
        raise ValueError("on_malformed is 'fail' or 'null'")
    started = time.perf_counter()
    listing = source_listing(spark, source)
    manifest = None if force else latest_manifest(spark, root)
    options = {"on_malformed": on_malformed, "multi_line": multi_line}
    seen = manifest and _unchanged(spark, root, source, listing, manifest, options)
    if seen and seen == manifest["source_fingerprint"]:
        return IngestResult(
            UNCHANGED,
            manifest["generation_id"],
            manifest["valid_rows"],
            manifest["discarded_rows"],
            seen,
        )

    generation = str(uuid4())
    try:
        result = _publish(spark, source, root, generation, listing, seen, options, started)
    except BaseException:
        remove_generation(spark, root, generation)
        raise
    forget_older(spark, root)
    return result


def counted_rows(raw: DataFrame, counts: Observation) -> DataFrame:
    """Typed rows of the extract with their verdicts; writing them fills ``counts``.

    Reading with digest, normalisation and rules are three parts of generated code.
    """
    tagged = raw.withColumn(_TEXT, row_text(RAW_COLUMNS)).withColumns(
        {
            _DIGEST: F.md5(F.col(_TEXT).cast("binary")),
            _SUSPECT: F.contains(F.col(_TEXT), F.lit(REPLACEMENT)),
        }
    )
    return observed(
        normalize(new_method(tagged), keep=(_DIGEST, MALFORMED, _SUSPECT)),
        counts,
        *fingerprint_counters(F.col(_DIGEST)),
        F.count_if(F.col(MALFORMED)).alias("malformed"),
        F.count_if(F.col(_SUSPECT)).alias("suspect"),
    )


def _publish(
    spark: SparkSession,
    source: str,
    root: str,
    generation: str,
    listing,
    seen: str | None,
    options: dict,
    started: float,
) -> IngestResult:
    """Write all parts of a generation, then let readers find it."""
    table = generation_path(root, generation, "sales")
    raw = read_sales_csv(spark, source, multi_line=options["multi_line"])
    counts = Observation()
    marked = counted_rows(raw, counts)
    write_sales(analytic_projection(marked.where(~F.col(INVALID))), table)
    seen_now = counts.get
    if options["on_malformed"] == "fail" and seen_now["malformed"]:
        raise IngestError(f"{seen_now['malformed']} lines have too few or too many fields")
    if options["on_malformed"] == "fail" and seen_now["suspect"]:
        # Only the bytes tell a character that was written from one that was lost.
        if damaged := damaged_lines(spark, source):
            raise IngestError(f"{damaged} lines are not UTF-8")
    statistics = seven_statistics(read_sales(spark, table)).first()

    source_fingerprint = fingerprint_text(seen_now)
    if source_listing(spark, source) != listing or (seen and seen != source_fingerprint):
        raise IngestError("the source changed while it was read")

    processed_at = datetime.now(UTC).isoformat(timespec="microseconds").replace("+00:00", "Z")
    valid, discarded = seen_now["valid_rows"], seen_now["discarded_rows"]
    totals = (seen_now["total_rows"], valid, discarded)
    write_rows(
        spark,
        [
            (generation, processed_at, POLICY, *totals, reason, seen_now[reason])
            for reason in REASONS
        ],
        QUALITY_SCHEMA,
        generation_path(root, generation, "quality"),
    )
    write_rows(
        spark,
        [(generation, processed_at, tuple(statistics[name] for name in STATISTIC_COLUMNS))],
        SUMMARY_SCHEMA,
        generation_path(root, generation, "summary"),
    )
    row = (
        generation,
        SCHEMA_VERSION,
        source,
        *(listing[name] for name in _LISTING),
        source_fingerprint,
        valid,
        discarded,
        processed_at,
        round(time.perf_counter() - started, 6),
        TARGET_HEADER,
        list(ANALYTIC_COLUMNS),
        *folder_listing(spark, table),
        options["on_malformed"],
        options["multi_line"],
    )
    write_rows(spark, [row], MANIFEST_SCHEMA, generation_path(root, generation, "manifest"))
    publish_generation(spark, root, generation, processed_at)
    return IngestResult(DONE, generation, valid, discarded, source_fingerprint)
