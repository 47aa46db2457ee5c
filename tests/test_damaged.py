from __future__ import annotations

from pathlib import Path

from harness import damaged, workspace
from pyspark.sql import functions as F

from tallyspark.plans.ingest import ingest
from tallyspark.sources.sales_csv import read_sales_csv

from .sales_fixture import valid_rows, write_csv

_FAILING = {
    "none": set(),
    "lost_file": {"row_counts"},
    "wrong_count": {"row_counts", "statistics"},
    "ninth_column": {"schema"},
    "missing_column": {"schema"},
    "missing_reason": {"reasons"},
    "too_many_rows_of_a_reason": {"reasons"},
    "other_id": {"generation", "publication", "statistics"},
    "other_time": {"publication"},
    "other_version": {"declaration"},
}


def test_one_damaged_copy_is_stored_at_a_time(spark, tmp_path, monkeypatch):
    root, folder = str(tmp_path / "root"), tmp_path / "damaged"
    (tmp_path / "csv").mkdir()
    for part in (0, 1):
        write_csv(tmp_path / "csv" / f"{part}.csv", valid_rows()[part::2])
    ingest(spark, str(tmp_path / "csv"), root)
    stored, original = [], damaged.dataset_checks

    def seen(*given):
        stored.append(len(list(folder.glob("*/gen=*/sales"))))
        return original(*given)

    monkeypatch.setattr(damaged, "dataset_checks", seen)
    rows = damaged.checks_of_damaged(spark, root, str(folder)).collect()
    assert stored == [1] * len(_FAILING)
    assert not list(folder.glob("**/*.parquet"))
    assert len(rows) == 7 * len(_FAILING)
    for name, failing in _FAILING.items():
        assert {row["check"] for row in rows if row["damage"] == name and not row["ok"]} == failing


def test_the_extract_is_compressed_in_files_of_few_rows(spark, tmp_path, monkeypatch):
    """With the rows, header and separator of the plain form."""
    monkeypatch.setitem(workspace._COMPRESSED, "maxRecordsPerFile", 40)
    raw = spark.range(100).select(
        *(F.concat(F.lit(f"{name} "), "id").alias(name) for name in valid_rows()[0])
    )
    for form in ("plain", "small"):
        more = workspace._COMPRESSED if form == "small" else None
        workspace.write_extract(raw.coalesce(1), str(tmp_path / form), ";", more)
    files = list(Path(tmp_path / "small").glob("part-*"))
    assert len(files) == 3 and all(file.name.endswith(".csv.gz") for file in files)
    plain, small = (read_sales_csv(spark, str(tmp_path / form)) for form in ("plain", "small"))
    assert small.count() == 100 and plain.exceptAll(small).isEmpty()
