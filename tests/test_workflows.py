import json

import pytest
from pyspark.sql import functions as F

from knotwork import session
from knotwork.operators import frames, mining, search, store
from knotwork.plans import workflows


@pytest.fixture(scope="module")
def relations(spark):
    rows = [("a", "A", "b", "B", "likes", "likes", 1, 1), ("b", "B", "c", "C", "knows", "knows", 2, 1), ("c", "C", "a", "A", "likes", "likes", 3, 2), ("x pipe", "X pipe", "y pipe", "Y pipe", "likes", "likes", 4, 3), ("x pipe", "X pipe", "z", "Z", "", "", 5, 3)]
    return spark.createDataFrame(rows, "src string, src_name string, dst string, dst_name string, predicate string, predicate_norm string, triplet_id long, document_id long")


def test_analyze(spark, relations):
    table = spark.createDataFrame([(1, "A", "likes", "B"), (2, "A", "hates", "B")], "row_key long, subject string, predicate string, object string")
    triplets = spark.createDataFrame([(1, 1, "A", "likes", "B")], "id long, document_id long, subject_text string, predicate_text string, object_text string")
    out = workflows.analyze_graph(relations, table, search.search_rows(triplets))
    m = out["metrics"].first()
    assert (m.nodes_count, m.edges_count, m.components_count, m.is_cyclic) == (6, 5, 2, True)
    assert [tuple(r) for r in out["cycles"].collect()] == [(3, "A -> B -> C")]
    assert out["table_recall"].first().recall == 0.5
    assert {r.component: r.root_norm for r in out["components"].collect()} == {"a": "a", "x pipe": "x pipe"}
    assert tuple(out["projection"].first())[0] == 2 and out["contexts"].count() == 6
    kinds = {r.type for r in workflows.derived_edges(out).collect()}
    assert "HAS_COMPONENT_ROOT" in kinds and kinds <= set(store.DERIVED_TYPES)


def test_entity_contexts_and_roots(spark, relations):
    got = {r.norm: r for r in mining.entity_contexts(relations).collect()}
    assert (got["x pipe"].out_preds, got["x pipe"].out_neighbors, got["b"].neighbors) == (["likes"], ["Y pipe", "Z"], ["A", "C"])
    rows = spark.createDataFrame([("r", "R", 0.5, 2, "b"), ("r", "R", 0.7, 3, "a")], "root_norm string, root_name string, cluster_score double, cluster_size long, child_name string")
    assert tuple(mining.clusters_by_root(rows).first()) == ("r", "R", 0.7, 3, 2, "a, b")


def test_role_frame(spark):
    slots = ['"te\\"x\\nt"', '{"text": "a", "frame": [{"text": "b"}]}', '{"frame": 3}', "null", "5", '{"sentence": "s", "triplets": []}']
    df = spark.createDataFrame([(s,) for s in slots], "s string").select(F.parse_json("s").alias("v"))
    got = [json.loads(r[0]) for r in df.select(frames.role_frame(F.col("v"))).collect()]
    assert got == [{"text": 'te"x\nt', "frame": []}, {"text": "a", "frame": [{"text": "b"}]}, {"text": "", "frame": []}, {"text": "", "frame": []}, {"text": "5", "frame": []}, {"text": "", "frame": []}]


def test_load_and_mine(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    (tmp_path / "p.json").write_text(json.dumps({"triplets": [{"subject": "стальная труба", "predicate": "есть", "object": "изделие"}, {"subject": "стальная трубa", "predicate": "есть", "object": "вещь"}]}))
    stored, counts = workflows.load_payloads(spark, str(tmp_path), store.empty_store(spark), now)
    assert counts.first().triplets == 2
    mined, found = workflows.mine_aliases(stored, now, least_cosine=0.7)
    assert [(r.canonical_norm, r.alias_norm) for r in found.collect()] == [("стальная трубa", "стальная труба")]
    assert mined["concept_aliases"].first().status == "candidate" and mined["concepts"].count() == 1


def test_written_leaves_only_its_result(spark):
    import os

    held = []

    def make():
        held.append(session.materialize(spark.range(5), "inner"))
        return held[0].where("id > 2")

    out = session.written(make, "outer")
    folder = lambda df: df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert out.count() == 2 and os.path.exists(folder(out)) and not os.path.exists(folder(held[0]))
    session.drop_materialized(out)
    assert not os.path.exists(folder(out))


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(Cluster)
