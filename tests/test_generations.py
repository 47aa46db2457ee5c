"""Publishing, finding and expiring generations, with readers and crashes in between."""

from __future__ import annotations

from datetime import timedelta
from pathlib import Path

import pytest

from tallyspark.plans import ingest as ingest_plan
from tallyspark.plans.ingest import ingest
from tallyspark.plans.query import published_sales
from tallyspark.sources.generations import (
    expire_generations,
    latest_manifest,
    manifests,
    newest_generations,
    publish_generation,
)

from .sales_fixture import valid_rows, write_csv

NOW = timedelta(0)


class Killed(Exception):
    """Stands for the end of the driver."""


def _stored(root: str) -> set[str]:
    return {path.name.removeprefix("gen=") for path in Path(root).glob("gen=*")}


def test_readers_survive_publication_and_expiry(spark, tmp_path):
    source, root = write_csv(tmp_path / "sales.csv", valid_rows()), str(tmp_path / "out")
    assert expire_generations(spark, root, NOW) == []
    first = ingest(spark, source, root).generation_id
    second = ingest(spark, source, root, force=True).generation_id
    reader = published_sales(spark, root)  # planned on the second generation
    assert expire_generations(spark, root, NOW) == []
    third = ingest(spark, source, root, force=True).generation_id

    assert [generation for _, generation in newest_generations(spark, root)] == [third, second]
    assert expire_generations(spark, root, timedelta(hours=1)) == []
    assert _stored(root) == {first, second, third}
    assert expire_generations(spark, root, NOW) == [first]
    assert _stored(root) == {second, third}
    assert reader.count() == 12
    assert latest_manifest(spark, root)["generation_id"] == third
    assert {row["generation_id"] for row in manifests(spark, root).collect()} == {second, third}


def test_a_crash_before_the_last_step_publishes_nothing(spark, tmp_path, monkeypatch):
    source, root = write_csv(tmp_path / "sales.csv", valid_rows()), str(tmp_path / "out")
    first = ingest(spark, source, root).generation_id

    def killed(*_):
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(ingest_plan, "publish_generation", killed)
        patch.setattr(ingest_plan, "remove_generation", lambda *_: None)
        with pytest.raises(Killed):
            ingest(spark, source, root, force=True)
    assert len(_stored(root)) == 2
    assert latest_manifest(spark, root)["generation_id"] == first
    assert published_sales(spark, root).count() == 12
    assert len(expire_generations(spark, root, NOW)) == 1
    assert _stored(root) == {first}


def test_a_crash_after_the_last_step_keeps_the_generation(spark, tmp_path, monkeypatch):
    source, root = write_csv(tmp_path / "sales.csv", valid_rows()), str(tmp_path / "out")

    def published_then_killed(*args):
        publish_generation(*args)
        raise Killed

    monkeypatch.setattr(ingest_plan, "publish_generation", published_then_killed)
    with pytest.raises(Killed):
        ingest(spark, source, root)
    assert published_sales(spark, root).count() == 12


def test_the_newest_generation_is_found_without_looking_at_others(spark, tmp_path):
    root = str(tmp_path / "out")
    for second in range(5):
        publish_generation(spark, root, f"g{second}", f"2024-01-01T00:00:0{second}.000000Z")
    found = newest_generations(spark, root)
    assert found[0] == ("20240101000004000000", "g4")
    assert latest_manifest(spark, root) is None  # named, but lost: nothing older is served
    with pytest.raises(OSError):
        publish_generation(spark, root, "g4", "2024-01-01T00:00:04.000000Z")
