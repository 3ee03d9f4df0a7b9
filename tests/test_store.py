"""Store, search, interchange, frames, evaluation, mining and grammar on literal rows."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from knotwork import session
from knotwork.operators import evaluate, frames, grammar, mining, search, store, tables
from knotwork.sources import interchange, readers
from knotwork.streaming import ingest



@pytest.fixture
def now(spark):
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def payload(spark, name, items):
    text = json.dumps({"triplets": items}, ensure_ascii=False)
    df = spark.createDataFrame([(name, text)], "source_name string, text string").select("source_name", F.try_parse_json("text").alias("payload"))
    return readers.payload_rows(readers.explode_payload(df))


ITEMS = [
    {"subject": "Сталь", "predicate": "имеет", "object": "цвет"},
    {"subject": {"text": "сталь", "frame": [{"text": "новая", "frame": []}]}, "predicate": "тип", "object": None, "sentence": "Сталь."},
    "noise",
]


def test_save_is_idempotent_and_delete_cascades(spark, now):
    rows = payload(spark, "f.json", ITEMS)
    assert [(r.row_idx, r.subject_text, r.object_text) for r in rows.orderBy("row_idx").collect()] == [(1, "Сталь", "цвет"), (2, "сталь", "")]
    first, counts = store.save_triplets(store.empty_store(spark), rows, now)
    assert tuple(counts.first()) == (1, 2, 5)
    again, _ = store.save_triplets(first, payload(spark, "g.json", ITEMS), now)
    for t in ("documents", "triplets", "triplet_frames", "frame_instances"):
        assert again[t].count() == first[t].count()
    assert [r.source_name for r in again["documents"].collect()] == ["g.json"]
    assert sorted(r.id for r in again["triplet_frames"].collect()) == [1, 2, 3, 4, 5]
    gone = store.cascade_delete(again, again["documents"].select("id"))
    assert {r.table_name: r.row_count for r in store.table_counts(gone).collect() if r.row_count} == {}


def test_saving_keeps_frames(spark, now):
    tree = {"text": "сталь", "frame": [{"text": "новая", "edge_label": "amod", "frame": ["очень", {"text": "", "frame": [{"text": "x"}]}]}, 5]}
    items = [{"subject": tree, "predicate": "есть", "object": {"text": "", "frame": [{"text": "inner"}]}}, {"subject": {"text": " a ", "lemma": "z"}, "predicate": None, "object": ""}]
    first, counts = store.save_triplets(store.empty_store(spark), payload(spark, "f.json", items), now, empty_frames=True)
    assert tuple(counts.first()) == (1, 2, 6)
    frames_of = {(r.triplet_id, r.role): json.loads(r.frame_json) for r in first["triplet_frames"].collect()}
    assert frames_of[1, "subject"] == tree and frames_of[1, "predicate"] == {"text": "есть", "frame": []} and frames_of[2, "object"] == {"text": "", "frame": []}
    role_of = {r.id: (r.triplet_id, r.role) for r in first["frame_instances"].collect()}
    nodes = {(*role_of[r.frame_instance_id], r.path): r for r in first["frame_nodes"].collect()}
    mine = {p: (r.node_text, r.node_lemma, r.edge_label, r.depth, r.ord, r.is_root) for (t, role, p), r in nodes.items() if (t, role) == (1, "subject")}
    assert mine == {
        "0": ("сталь", "сталь", None, 0, 0, True), "0.0": ("новая", "новая", "amod", 1, 0, False), "0.0.0": ("очень", "очень", None, 2, 0, False), "0.0.1": ("", "", None, 2, 1, False),
        "0.0.1.0": ("x", "x", None, 3, 0, False), "0.1": ("5", "5", None, 1, 1, False)}
    assert all(nodes[t, r, p.rpartition(".")[0]].id == n.parent_node_id if "." in p else n.parent_node_id is None for (t, r, p), n in nodes.items())
    # Saved again: nothing moves. A changed tree of the same triplet: its paths are replaced, others stay.
    again, _ = store.save_triplets({k: v for k, v in first.items()}, payload(spark, "f.json", items), now, empty_frames=True)
    for t in store.SAVED:
        assert sorted(map(tuple, again[t].collect()), key=repr) == sorted(map(tuple, first[t].collect()), key=repr)
    some, counts = store.save_triplets(store.empty_store(spark), payload(spark, "f.json", items), now)
    assert counts.first().frames == 4 and some["frame_instances"].where("role = 'object'").count() == 1
    smaller = frames.flatten(spark.createDataFrame([(1, "subject", '{"text": "y", "frame": ["z"]}')], "triplet_id long, role string, t string").select("triplet_id", "role", F.parse_json("t").alias("frame")), ["triplet_id", "role"])
    left = store.save_frame_nodes(again["frame_nodes"], smaller, again["frame_instances"], now)
    at = next(k for k, v in role_of.items() if v == (1, "subject"))
    assert {(r.path, r.node_text, r.id) for r in left.where(F.col("frame_instance_id") == at).collect()} == {("0", "y", nodes[1, "subject", "0"].id), ("0.0", "z", nodes[1, "subject", "0.0"].id)}
    assert left.count() == again["frame_nodes"].count() - 4


def test_malformed_payloads(spark):
    df = spark.createDataFrame([("a", "[1]"), ("b", "{}"), ("c", '{"triplets": 3}'), ("d", "{"), ("e", '{"triplets": []}')], "source_name string, text string")
    got = readers.malformed_payloads(df.select("source_name", F.try_parse_json("text").alias("payload")))
    assert {r.source_name: r.reason for r in got.collect()} == {"a": "not an object", "b": "no triplets", "c": "triplets is no list", "d": "not JSON"}


def test_graph_write_and_cleanup(spark):
    t = spark.createDataFrame([(1, 9, "A", "likes", "b"), (2, 9, "a", "", "C"), (3, 8, "x", "y", "")], "id long, document_id long, subject_text string, predicate_text string, object_text string").withColumn("sentence_text", F.lit(None).cast("string"))
    nodes = store.concept_nodes(t)
    assert {r.norm: r.name for r in nodes.collect()} == {"a": "A", "b": "b", "c": "C", "x": "x"}
    edges = store.relation_edges(t)
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("a", "c")}
    assert store.write_graph(edges, t.where("id = 1")).count() == 2
    kept, left = store.delete_from_graph(edges, nodes, spark.createDataFrame([(9,)], "document_id long"))
    assert kept.count() == 0 and left.count() == 0
    assert store.role_edges(t).where("type = 'OBJECT'").count() == 2


def test_links_and_components(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "norm string")
    asked = spark.createDataFrame([("a", "b", "alias", "r", ""), ("a", "b", "odd", "r", ""), ("a", "z", "alias", "r", "")], "src string, dst string, kind string, relation_text string, note string")
    assert sorted(r.type for r in store.approved_links(asked, nodes).collect()) == ["APPROVED_ALIAS_OF", "MANUAL_CONTEXT_LINK"]
    kids = spark.createDataFrame([(1, "Root"), (2, "Kid"), (3, " kid "), (4, "")], "ord int, name string")
    assert [tuple(r) for r in store.synonym_component(F.lit("root"), kids).select("src", "dst", "name").collect()] == [("root", "kid", "Kid")]
    node, edges = store.connector(spark, "a", "b", "joins")
    assert node.first().norm == "joins" and {(r.src, r.dst) for r in edges.collect()} == {("a", "joins"), ("joins", "b")}
    with pytest.raises(ValueError, match="derived"):
        store.rebuild_derived(edges, edges, "OTHER")


def test_concepts_keep_approval_and_merge(spark, now):
    c = store.ensure_concepts(spark.createDataFrame([], store.SCHEMAS["concepts"]), spark.createDataFrame([("a", "A"), ("b", "B")], "canonical_norm string, canonical_name string"), now)
    approved = c.withColumn("concept_type", F.when(F.col("canonical_norm") == "a", "approved").otherwise(F.col("concept_type")))
    again = store.ensure_concepts(approved, spark.createDataFrame([("a", "AA"), ("c", "C")], "canonical_norm string, canonical_name string"), now)
    assert {r.canonical_norm: (r.id, r.canonical_name, r.concept_type) for r in again.collect()} == {"a": (1, "AA", "approved"), "b": (2, "B", "candidate"), "c": (3, "C", "candidate")}
    aliases = spark.createDataFrame([(1, 2, "bb", "bb", "mined", 0.5, "rejected", None, None), (2, 1, "bb", "bb", "mined", 0.7, "candidate", None, "n")], store.SCHEMAS["concept_aliases"])
    links = spark.createDataFrame([(5, 2, "t", 0.1, "m"), (5, 1, "t", 0.4, None)], "node_id long, concept_id long, link_type string, score double, method string")
    kept, merged, moved = store.merge_concepts(again, aliases, links, spark.createDataFrame([(2, 1)], "source_id long, target_id long"), now, "why")
    assert sorted(r.canonical_norm for r in kept.collect()) == ["a", "c"]
    assert {(r.alias_norm, r.confidence, r.status, r.review_note) for r in merged.collect()} == {("bb", 0.7, "candidate", "n"), ("b", 1.0, "approved", "why")}
    assert [tuple(r) for r in moved.collect()] == [(5, 1, "t", 0.4, "m")]


def test_search(spark):
    t = spark.createDataFrame([(1, 1, "труба", "p", "50% off", None), (2, 2, "Балка", "p", "x", "s")], "id long, document_id long, subject_text string, predicate_text string, object_text string, sentence_text string")
    assert [r.triplet_id for r in search.triplet_list(t, contains="БАЛ").collect()] == [2]
    assert [r.triplet_id for r in search.triplet_list(t, contains="50%").collect()] == [1]
    assert search.triplet_list(t, contains="5_%").count() == 0
    assert search.triplet_by_id(t, 2).first().sentence == "s"
    with pytest.raises(ValueError, match="unsupported"):
        search.browse_table({}, "nope")
    nodes, edges = search.payload_graph(spark.createDataFrame([(1, "a", "", "b"), (2, "a", "p", None)], "row_idx int, subject_text string, predicate_text string, object_text string"))
    assert {r.node for r in nodes.collect()} == {"a", "b", "∅"} and {r.label for r in edges.collect()} == {"∅", "p"}


def test_json_and_graphml_round_trip(spark, tmp_path):
    doc = {"nodes": [{"id": 0, "label": "A", "properties": {"name": "x<y", "k": 1}}, {"labels": [], "properties": 5}, "bad"], "relationships": [{"from": 0, "to": "node_1", "type": "t"}, {"from": 0}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, edges = interchange.read_graph(spark, str(tmp_path / "g.json"))
    assert {(r.id, tuple(r.labels), r.properties.get("name"), r.properties.get("value")) for r in nodes.collect()} == {("0", ("A",), "x<y", None), ("node_1", ("ImportedNode",), None, "5")}
    assert [(r.id, r.source, r.target, r.type) for r in edges.collect()] == [("edge_0", "0", "node_1", "t")]
    lines = [r.line for r in interchange.graphml_lines(nodes, edges).orderBy("part", "ord").collect()]
    (tmp_path / "g.graphml").write_text("\n".join(lines))
    nodes2, edges2 = interchange.read_graph(spark, str(tmp_path / "g.graphml"))
    assert {(r.properties["neo4j_element_id"], r.properties["label"], tuple(r.labels)) for r in nodes2.collect()} == {("0", "x<y", ("A",)), ("node_1", "n1", ("ImportedNode",))}
    assert nodes2.where("properties['name'] = 'x<y'").count() == 1
    assert [(r.source, r.target, r.type) for r in edges2.collect()] == [("n0", "n1", "t")]
    with pytest.raises(ValueError, match="supported"):
        interchange.read_graph(spark, "x.txt")


def test_import_counts_and_dot(spark):
    nodes = spark.createDataFrame([("1", ["My Label"], {"a b": "c", "n": None}), ("2", [], {})], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("", "1", "2", "t t", {}), ("e", "1", "9", "t", {})], "id string, source string, target string, type string, properties map<string,string>")
    new, placed, counts = interchange.import_graph(nodes, edges, " Space ")
    assert tuple(counts.first()) == (2, 0, 1, 1)
    assert new.where("import_key = 'space::1'").first().properties == {"a_b": "c"}
    assert placed.first().import_id == "1->2:T_T"
    _, _, counts = interchange.import_graph(nodes, edges, "Space", new, placed)
    assert tuple(counts.first()) == (0, 2, 0, 1)
    assert interchange.dot_text(edges).first().dot.startswith('digraph G {\n  "1" -> "2" [label="t t"];')


def test_frames(spark):
    tree = {"text": "a", "frame": [{"text": "b", "frame": [{"text": "c"}]}, {"text": "", "frame": [{"text": "d"}]}] + [{"text": f"x{i}"} for i in range(10)]}
    df = spark.createDataFrame([(1, "subject", json.dumps(tree)), (2, "object", '{"text": ""}')], "triplet_id long, role string, t string").select("triplet_id", "role", F.parse_json("t").alias("frame"))
    nodes = frames.flatten(df, ["triplet_id", "role"])
    got = {(r.path, r.text, r.depth) for r in nodes.where("triplet_id = 1").collect()}
    assert {("0", "a", 0), ("0.0.0", "c", 2), ("0.1.0", "d", 2), ("0.11", "x9", 1)} <= got and len(got) == 15
    assert {r.triplet_id: (r.nodes, r.has_content) for r in frames.fold(nodes, ["triplet_id"]).collect()} == {1: (14, True), 2: (0, False)}
    order = [r.path for r in frames.frame_tree(nodes.where("triplet_id = 1 and depth = 1"), ["triplet_id", "role"]).collect()]
    assert order == [f"0.{i}" for i in range(12)]
    assert frames.subtree(nodes.where("triplet_id = 1"), [], "0.1").count() == 2
    inner = spark.createDataFrame([(1, 1, "a", ["k"], 2, ["a", "k"]), (1, 2, "b", [], 1, ["b"]), (1, 3, "k", [], 1, ["k"])], "triplet_id int, position int, text string, frame array<string>, nodes int, all_texts array<string>")
    assert tuple(frames.normalize_slots(inner, ["triplet_id"], "subject").first()) == (1, "subject", "a", ["k", "b"])


def test_evaluation_kinds(spark):
    table = spark.createDataFrame([(1, "Труба", "1,5", "мм"), (2, "Балка", "2", ""), (3, "лист", "тонкий", "вид"), (4, "нет", "3", "x")], "row_key long, subject string, predicate string, object string")
    stored = spark.createDataFrame([(10, 1, "труба", "1.5", "ММ"), (11, 1, "большой лист стали", "очень тонкий", "вид")], "id long, document_id long, subject_text string, predicate_text string, object_text string")
    rel = spark.createDataFrame([("балка", "Балка", "q", "Q", "2", "2", 12, 1), ("нет", "нет", "x", "x", "3", "3", None, 1)], "src string, src_name string, dst string, dst_name string, predicate string, predicate_norm string, triplet_id long, document_id long")
    detail = evaluate.evaluate(table, search.search_rows(stored), rel)
    assert {r.row_key: (r.status, r.match_type, r.matched_triplet_id) for r in detail.collect()} == {1: ("TP", "direct_triplet", 10), 2: ("TP", "direct_relation", 12), 3: ("TP", "frame_fallback", 11), 4: ("FN", "", None)}
    assert tuple(evaluate.recall(detail).first()) == (4, 3, 1, 0.75)
    assert evaluate.recall(detail.where("false")).first().recall == 0.0


def test_containment_candidates_equal_the_full_join(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 6)))
    table = spark.createDataFrame([(i, word(), word(), word()) for i in range(60)], "row_key long, subject string, predicate string, object string")
    stored = spark.createDataFrame([(100 + i, 1, word(), word(), word()) for i in range(40)], "id long, document_id long, subject_text string, predicate_text string, object_text string")
    none = spark.createDataFrame([], "src string, src_name string, dst string, dst_name string, predicate string, predicate_norm string, triplet_id long, document_id long")
    got = {r.row_key: r.matched_triplet_id for r in evaluate.evaluate(table, search.search_rows(stored), none).collect()}
    clean = lambda t: " ".join(t.split())
    fits = lambda v, k: v == k or bool(v and k and (v in k or k in v))
    for t in table.collect():
        slots = [clean(x) for x in (t.subject, t.predicate, t.object)]
        rows = [(s.id, [clean(x) for x in (s.subject_text, s.predicate_text, s.object_text)]) for s in stored.collect()] if t.row_key == 0 else rows
        same = [i for i, k in rows if k == slots]
        near = [i for i, k in rows if all(fits(v, x) for v, x in zip(slots, k, strict=True))]
        assert got[t.row_key] == (min(same) if same else min(near, default=None)), slots


def test_candidate_pairs_lose_nothing(spark):
    rows = [("a", "a", ["p"], [], ["k"], 1, [1], [1.0, 0.0]), ("b", "b", [], ["p"], [], 2, [2], [1.0, 0.1]), ("c", "c", ["q"], [], ["k"], 1, [], [0.0, 1.0]), ("d", "d", [], [], [], 1, [], [0.0, 1.0])]
    c = spark.createDataFrame(rows, "norm string, name string, out_preds array<string>, in_preds array<string>, child_terms array<string>, occ_count long, document_ids array<long>, embedding array<double>")
    every = {(r.l_norm, r.r_norm): r.structural for r in mining.context_pair_scores(c).collect()}
    some = {(r.l_norm, r.r_norm): r.structural for r in mining.context_pair_scores(c, least_structural=0.2).collect()}
    assert len(every) == 6 and {k for k, v in every.items() if v >= 0.2} <= set(some)
    assert every["a", "b"] == pytest.approx(0.45 + 0.05) and every["c", "d"] == pytest.approx(0.10)
    assert mining.context_pair_scores(c, frames=False).where("l_norm = 'c' and r_norm = 'd'").first().structural == pytest.approx(0.15)


def test_cluster_names_and_clusters(spark):
    e = spark.createDataFrame([("hot rolled pipe", "Hot rolled pipe", ["p"], ["n"], [1.0]), ("pipe rolled", "pipe rolled", ["p"], ["n"], [1.0]), ("other", "other", [], [], [0.0])], "norm string, name string, preds array<string>, neighbors array<string>, embedding array<double>")
    got = [tuple(r) for r in mining.entity_clusters(e).select("child_norm", "root_norm", "cluster_size").collect()]
    assert got == [("hot rolled pipe", "pipe rolled", 2)]


WORD = "id int, text string, lemma string, upos string, feats map<string,string>, head int, deprel string"


def sentence(spark, words, sid=1):
    return spark.createDataFrame([(sid, *w) for w in words], "sentence_id long, " + WORD)


def test_grammar(spark):
    tokens = sentence(spark, [
        (1, "Мама", "мама", "NOUN", {"Case": "Nom"}, 3, "nsubj"), (2, "папа", "папа", "NOUN", {}, 1, "conj"), (3, "моют", "мыть", "VERB", {}, 0, "root"),
        (4, "раму", "рама", "NOUN", {"Case": "Acc"}, 3, "obj"), (5, "чистую", "чистый", "ADJ", {}, 4, "amod"), (6, "и", "и", "CCONJ", {}, 7, "cc"), (7, "поют", "петь", "VERB", {}, 3, "conj")])
    got = {(r.subject, r.predicate, r.object) for r in grammar.extract(tokens).collect()}
    assert got == {("Мама", "моют", "раму"), ("папа", "моют", "раму"), ("Мама", "поют", ""), ("папа", "поют", "")}
    shared = {(r.subject, r.predicate, r.object) for r in grammar.extract(tokens, share_objects=True).collect()}
    assert ("Мама", "поют", "раму") in shared
    t = grammar.extract(tokens).where("subject = 'Мама' and object = 'раму'").withColumn("triplet_key", F.lit(1))
    frame = {(r.role, r.path, r.text) for r in grammar.frame_rows(tokens, t).collect()}
    assert ("object", "0", "рама") in frame and ("object", "0.0", "чистую") in frame and not any(r == "subject" and x == "мыть" for r, _, x in frame)


def test_grammar_pronoun_root_and_modal(spark):
    rel = sentence(spark, [
        (1, "завод", "завод", "NOUN", {"Gender": "Masc", "Number": "Sing"}, 4, "nsubj"), (2, "который", "который", "PRON", {}, 3, "nsubj"), (3, "строит", "строить", "VERB", {}, 1, "acl:relcl"),
        (4, "работает", "работать", "VERB", {}, 0, "root"), (5, "может", "мочь", "VERB", {}, 4, "conj")])
    assert {(r.subject, r.predicate) for r in grammar.extract(rel).collect()} == {("завод", "строит"), ("завод", "работает")}
    root = sentence(spark, [(1, "трубы", "труба", "NOUN", {}, 0, "root"), (2, "балки", "балка", "NOUN", {}, 1, "conj")])
    assert {(r.subject, r.predicate) for r in grammar.extract(root).collect()} == {("трубы", ""), ("балки", "")}
    assert spark.range(1).select(grammar.prepare(F.lit("металлы такие как медь"))).first()[0] == "металлы: медь"


def test_plugged_parser_and_backend(spark):
    s = spark.createDataFrame([(1, "x y")], "sentence_id long, text string")
    parser = lambda text: [{"id": i, "text": w, "lemma": w, "upos": "NOUN", "feats": {}, "head": 0, "deprel": "root"} for i, w in enumerate(text.split(), 1)]
    assert grammar.parse_sentences(s, parser).count() == 2
    raw = readers.tables_from_rows(spark, {"x.csv": [["n", "a"], ["p", "1"]]})

    def backend(batches):
        for pdf in batches:
            yield pdf.assign(row_idx=1, col_idx=1, subject=pdf["prompt"], predicate="p", object="o")[["table_file", "row_idx", "col_idx", "subject", "predicate", "object"]]

    assert tables.extract_triplets(raw, backend).first().subject == "n;a\np;1"


def test_streaming_ingest(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    (source / "a.json").write_text(json.dumps({"triplets": ITEMS}, ensure_ascii=False))
    ingest.start_ingest(spark, str(source), str(folder), str(tmp_path / "cp")).awaitTermination()
    (source / "b.json").write_text(json.dumps({"triplets": ITEMS}, ensure_ascii=False))
    ingest.start_ingest(spark, str(source), str(folder), str(tmp_path / "cp")).awaitTermination()
    stored = ingest.load_store(spark, str(folder), 1)
    assert [r.source_name for r in stored["documents"].collect()] == ["b.json"] and stored["triplets"].count() == 2
    assert (stored["frame_instances"].count(), stored["frame_nodes"].count()) == (6, 7)


def test_streaming_keeps_other_tables(spark, tmp_path, now):
    """Tables that ingestion does not change come from the version that wrote them."""
    folder = str(tmp_path / "store")
    start = store.empty_store(spark)
    start["concepts"] = store.ensure_concepts(start["concepts"], spark.createDataFrame([("a", "A")], "canonical_norm string, canonical_name string"), now)
    ingest.save_store(start, folder, 0)
    batch = spark.createDataFrame([("f.json", json.dumps({"triplets": ITEMS}))], "source_name string, text string")
    ingest.ingest_batch(batch, 1, folder)
    got = ingest.load_store(spark, folder, 1)
    assert {t: got[t].count() for t in got} == {"documents": 1, "triplets": 2, "triplet_frames": 6, "frame_instances": 6, "frame_nodes": 7, "concepts": 1, "concept_aliases": 0, "node_concept_links": 0}


def test_deep_frames_take_one_pass(spark):
    tree = {"text": "n0"}
    for k in range(1, 300):
        tree = {"text": f"n{k}", "frame": [tree]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "triplet_id long, t string").select("triplet_id", F.parse_json("t").alias("frame"))
    got = frames.flatten(df, ["triplet_id"])
    assert got.count() == 300 and got.agg(F.max("depth")).first()[0] == 299


def test_content_hash_equals_sorted_json(spark):
    data = {"triplets": [{"subject": "Сталь", "object": {"text": "b", "frame": [{"z": 1, "a": [1.5, None, True]}]}, "predicate": "é\"\n"}], "a": {}}
    df = spark.createDataFrame([("f", json.dumps(data, indent=1))], "source_name string, text string").select("source_name", F.parse_json("text").alias("payload"))
    assert readers.explode_payload(df).first().content_hash == hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_sanitize(spark):
    df = spark.createDataFrame([(1, b"a", ["я".encode("cp1251"), None], {2: b"x"}), (2, None, None, None)], "id int, raw binary, many array<binary>, by map<int,binary>")
    got = readers.sanitize(df).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", ["я", None], {"2": "x"}), (2, None, None, None)]
    assert readers.sanitize(df.select("id")).dtypes == [("id", "int")]


def test_json_document(spark):
    nodes = spark.createDataFrame([("b", ["L"], {"k": "v\n"}), ("a", [], {})], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([], "id string, source string, target string, type string, properties map<string,string>")
    kept, inside, meta = interchange.export_subgraph(nodes, edges)
    lines = [r.line for r in interchange.graph_document(kept, inside, meta).orderBy("part", "ord").collect()]
    want = {"nodes": [{"id": "a", "labels": [], "properties": {}}, {"id": "b", "labels": ["L"], "properties": {"k": "v\n"}}], "edges": [], "meta": meta.first().asDict()}
    assert "\n".join(lines) == json.dumps(want, ensure_ascii=False, indent=2)


def test_export_filters_edges_before_the_limit(spark):
    node = "id string, labels array<string>, properties map<string,string>"
    nodes = spark.createDataFrame([("r1", ["X"], {"c": "red"}), ("r2", ["X"], {"c": "red"}), ("b1", ["X"], {"c": "Blue"}), ("b2", ["X"], {"c": "blue"}), ("l", ["Bluebird"], {"c": None})], node)
    rows = [(1, "r1", "r2", "T", {}), (2, "r2", "r1", "T", {}), (3, "b1", "b2", "T", {}), (4, "r1", "b1", "T", {}), (5, "r1", "r2", "BLUE", {}), (6, "r1", "r2", "T", {"k": "so blue"}), (7, "l", "r1", "T", None), (8, "gone", "r1", None, {})]
    edges = spark.createDataFrame(rows, "id long, source string, target string, type string, properties map<string,string>")

    def export(**limits):
        kept, inside, meta = interchange.export_subgraph(nodes, edges, "blue", **limits)
        return sorted(r.id for r in kept.collect()), sorted(r.id for r in inside.collect()), meta.first().skipped_edges_outside_node_limit

    assert export(edge_limit=2) == (["b1", "b2", "l"], [3], 1)
    assert export() == (["b1", "b2", "l"], [3], 3)  # 4, 5 and 6 pass the filter; labels of end nodes do not count


def test_written_in_threads(spark):
    """What another thread stores while a call is open is not that call's to delete."""
    opened, stored = threading.Event(), threading.Event()
    kept = {}

    def other():
        opened.wait(60)
        kept["own"] = session.materialize(spark.range(5), "other")
        kept["nested"] = session.written(lambda: session.materialize(spark.range(3), "inner"), "other")
        stored.set()

    def make():
        inner = session.materialize(spark.range(7), "inner")
        again = session.written(lambda: session.materialize(inner, "deeper"), "again")
        opened.set()
        assert stored.wait(60)
        kept["inner"], kept["again"] = inner, again
        return again

    thread = threading.Thread(target=other)
    thread.start()
    out = session.written(make, "out")
    thread.join()
    assert (out.count(), kept["own"].count(), kept["nested"].count()) == (7, 5, 3)
    for gone in ("inner", "again"):
        with pytest.raises(Exception, match="(?i)not.?exist"):
            kept[gone].count()


def test_typed_properties(spark):
    doc = {"a b": 1, "t": True, "n": None, "l": [1, None, 2], "m": [[1], 2], "o": {"x": 1}, "s": "q", "e": []}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",)], "t string").select(F.parse_json("t").alias("v"))
    rows = df.select(F.transform_values(interchange.typed_properties(F.col("v")), lambda k, v: F.to_json(v)).alias("m")).collect()
    assert {k: json.loads(v) for k, v in rows[0].m.items()} == {"a_b": 1, "t": True, "l": [1, 2], "m": "[[1],2]", "o": '{"x":1}', "s": "q", "e": []} and rows[1].m == {}


@pytest.mark.parametrize("cell_rows", [1, 3, 1024])
def test_pairs_within_any_grid(spark, cell_rows):
    rng = random.Random(cell_rows)
    rows = sorted({(f"n{rng.randrange(30)}", f"i{rng.randrange(4)}") for _ in range(90)})
    want = {(a, b) for a, i in rows for b, j in rows if i == j and a < b}
    got = mining.pairs_within(spark.createDataFrame(rows, "norm string, item string"), cell_rows).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_default_thresholds_lose_no_pair(spark):
    """Candidates at 0.10 against all pairs: those without a common item pass by equal counts alone."""
    rng = random.Random(3)
    some = lambda: sorted(rng.sample(["p", "q", "r", "s", "t", "u"], rng.randrange(3)))
    rows = [(f"c{k}", f"c{k}", some(), some(), some(), rng.choice([0, 1, 1, 2, 5]), [k % 4], [1.0, float(k % 3)]) for k in range(40)]
    contexts = spark.createDataFrame(rows, "norm string, name string, out_preds array<string>, in_preds array<string>, child_terms array<string>, occ_count long, document_ids array<int>, embedding array<double>")
    passed = lambda df: {(r.l_norm, r.r_norm, round(r.structural, 9), round(r.combined, 9)) for r in df.where("round(structural, 12) >= 0.10").collect()}
    assert passed(mining.context_pair_scores(contexts, True, 0.10)) == passed(mining.context_pair_scores(contexts, True, 0.0))


def test_containment_candidates_follow_the_rows(spark):
    """Strings that differ in a number only: the rarest trigram of each is in a hundredth of the others."""
    name = F.concat(F.lit("item-"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("x"))
    empty = F.array().cast("array<string>")
    for inner, outer in ((name, F.concat(F.lit("the "), name, F.lit(" of steel"))), (F.concat(F.lit("the "), name, F.lit(" of steel")), name)):
        rest = spark.range(1000).select(F.col("id").alias("row_key"), inner.alias("c_subject"), F.lit("is").alias("c_predicate"), F.lit("part").alias("c_object"))
        index = spark.range(1000).select(F.col("id").alias("entry"), F.array(outer).alias("f_subject"), empty.alias("f_predicate"), empty.alias("f_object"))
        found = {tuple(r) for r in evaluate.containment_candidates(rest, index).collect()}
        assert {(k, k) for k in range(1000)} <= found and len(found) < 2000


def test_first_spelling_sorts_few_rows(spark):
    """The rows of each concept are reduced by hash before one name is chosen."""
    rows = [(3, "A b", "x"), (1, "a B", "X"), (2, "a b", "A B"), (1, "a B", "a b")]
    nodes = store.concept_nodes(spark.createDataFrame(rows, "id long, subject_text string, object_text string"))
    assert {tuple(r) for r in nodes.collect()} == {("a b", "a B"), ("x", "X")}
    assert "HashAggregate" in nodes._jdf.queryExecution().executedPlan().toString()


def test_grammar_broadcasts_no_tokens(spark):
    tokens = spark.range(30).select(F.col("id").alias("sentence_id"), F.inline(F.array(*(
        F.struct(F.lit(i).alias("id"), F.lit(t).alias("text"), F.lit(t).alias("lemma"), F.lit(tag).alias("upos"), F.create_map().cast("map<string,string>").alias("feats"), F.lit(head).alias("head"), F.lit(rel).alias("deprel"))
        for i, t, tag, head, rel in ((1, "bolt", "NOUN", 2, "nsubj"), (2, "weighs", "VERB", 0, "root"), (3, "Brand", "PROPN", 2, "obj"))))))
    found = grammar.extract(tokens)
    assert {tuple(r) for r in found.select("subject", "predicate", "object").collect()} == {("bolt", "weighs", "Brand")} and found.count() == 30
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 4
