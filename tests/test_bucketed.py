"""Saves into buckets against saves of whole tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import bucketed, store
from knotwork.sources import readers
from knotwork.streaming import ingest

WIDTHS = {"rows": 8, "documents": 2}


def payload(spark, docs):
    rows = [(n, json.dumps({"triplets": t}, ensure_ascii=False)) for n, t in docs]
    df = spark.createDataFrame(rows, "source_name string, text string").select("source_name", F.try_parse_json("text").alias("payload"))
    return readers.payload_rows(readers.explode_payload(df))


def items(seed, n):
    rng = random.Random(seed)
    return [{"subject": {"text": f"s{rng.randrange(9)}", "frame": [{"text": "in", "frame": []}]}, "predicate": "is", "object": f"o{seed} {k}"} for k in range(n)]


def content(tables):
    drop = {"created_at", "approved_at"}
    return {t: sorted((tuple(r) for r in tables[t].drop(*drop).collect()), key=repr) for t in store.SAVED}


def written(spark, folder, version):
    return {t: set(v.values()) for t, v in bucketed.load_manifest(spark, folder, version).tables.items()}


@pytest.fixture
def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def test_equals_whole_tables(spark, tmp_path, now):
    """Several saves, some again with other names or sentences: the same rows and ids as in one store."""
    folder, whole = str(tmp_path / "s"), store.empty_store(spark)
    for docs in ([("a", items(1, 4)), ("b", items(2, 3))], [("c", items(3, 5)), ("renamed", items(1, 4))]):
        p = payload(spark, docs)
        saved, _ = store.save_triplets(whole, p, now)
        whole = {t: spark.createDataFrame(df.collect(), df.schema) for t, df in saved.items()}
        bucketed.save_payload(spark, folder, p, now, **WIDTHS)
        assert content(bucketed.read_store(spark, folder)) == content(whole)
    assert len(content(bucketed.read_store(spark, folder, 1))["documents"]) == 2  # older versions stay readable


def test_only_touched_buckets_are_written(spark, tmp_path, now):
    folder = str(tmp_path / "s")
    bucketed.save_payload(spark, folder, payload(spark, [(f"f{k}", items(k, 4)) for k in range(16)]), now, **WIDTHS)
    before = written(spark, folder, 1)
    assert len(before["triplets"]) > 6 and len(before["frame_nodes"]) > 10
    bucketed.save_payload(spark, folder, payload(spark, [("again", items(3, 4))]), now)
    after = written(spark, folder, 2)
    for t in store.SAVED:
        assert 0 < len(after[t] - before[t]) <= 8 and len(after[t]) == len(before[t])
    assert len(after["documents"] - before["documents"]) == 1 and len(after["triplets"] - before["triplets"]) <= 2


def test_crash_and_conflict_leave_the_old_version(spark, tmp_path, now, monkeypatch):
    folder = str(tmp_path / "s")
    bucketed.save_payload(spark, folder, payload(spark, [("a", items(1, 2))]), now, **WIDTHS)
    before = content(bucketed.read_store(spark, folder))
    with monkeypatch.context() as m:
        m.setattr(bucketed, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            bucketed.save_payload(spark, folder, payload(spark, [("b", items(2, 2))]), now)
    assert content(bucketed.read_store(spark, folder)) == before
    old = bucketed.load_manifest(spark, folder)
    with monkeypatch.context() as m:  # another save has started from the version before
        m.setattr(bucketed, "load_manifest", lambda *a: bucketed.Manifest(0, rows=8, documents=2))
        with pytest.raises(RuntimeError, match="another save"):
            bucketed.save_payload(spark, folder, payload(spark, [("c", items(3, 2))]), now)
    assert bucketed.load_manifest(spark, folder) == old and content(bucketed.read_store(spark, folder)) == before
    assert bucketed.vacuum(spark, folder) > 0 and bucketed.vacuum(spark, folder) == 0
    assert content(bucketed.read_store(spark, folder)) == before


def test_batches_cost_alike(spark, tmp_path, monkeypatch):
    """What a batch writes does not follow the batches before it; a batch that comes again writes nothing."""
    monkeypatch.setattr(bucketed, "COMPLETE", 2)
    monkeypatch.setattr(bucketed.save_payload, "__defaults__", (None, False, 8, 2))
    folder = str(tmp_path / "s")
    batch = lambda k: spark.createDataFrame([(f"f{k}", json.dumps({"triplets": items(k, 3)}))], "source_name string, text string")
    costs = [sum(ingest.ingest_bucketed(batch(k), k, folder).values()) for k in range(6)]
    assert max(costs[3:]) <= 14 and sum(ingest.ingest_bucketed(batch(5), 5, folder).values()) == 0
    got = bucketed.read_store(spark, folder)
    assert got["documents"].count() == 6 and got["triplets"].count() == 18
    assert got["triplets"].select("id").distinct().count() == 18 and got["frame_nodes"].select("id").distinct().count() == got["frame_nodes"].count()
    kept = bucketed._versions(spark, folder)
    assert kept[-1] == 6 and kept[0] >= 3
    with pytest.raises(ValueError, match="not kept"):
        bucketed.load_manifest(spark, folder, 1)


def test_hash_buckets_split(spark, tmp_path, now):
    folder = str(tmp_path / "s")
    bucketed.save_payload(spark, folder, payload(spark, [(f"f{k}", items(k, 1)) for k in range(20)]), now, rows=1, documents=4)
    bucketed.save_payload(spark, folder, payload(spark, [("new", items(99, 1))]), now)
    m = bucketed.load_manifest(spark, folder)
    assert m.hash_buckets == 32 and bucketed.read_table(spark, folder, "documents").count() == 21
    bucketed.save_payload(spark, folder, payload(spark, [("renamed", items(5, 1))]), now)
    names = {r.source_name for r in bucketed.read_table(spark, folder, "documents").collect()}
    assert len(names) == 21 and "renamed" in names and "f5" not in names


def test_empty(spark, tmp_path, now):
    folder = str(tmp_path / "s")
    assert all(not rows for rows in content(bucketed.read_store(spark, folder)).values())
    bucketed.save_payload(spark, folder, payload(spark, [("a", items(1, 1))]).where("false"), now)
    assert bucketed.load_manifest(spark, folder).version == 1 and bucketed.read_table(spark, folder, "triplets").count() == 0
