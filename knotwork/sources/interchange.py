"""Graph interchange: JSON and GraphML in and out, import with counts, DOT text.

A graph is two DataFrames: nodes(id, labels, properties) and edges(id, source, target, type, properties), with
properties as a map of strings to JSON-ready strings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, entity_name, escape_dot, identifier, relation_type, shorten
from ..operators.store import numbered
from ..session import materialize

PROPERTIES = "map<string,string>"


def _text(v: str, *paths: str) -> Column:
    """The first of the paths that holds a non-empty value, as text. 0 counts as a value."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths))


def _properties(v: str) -> Column:
    raw = F.try_variant_get(v, "$.properties", "variant")
    shape = F.schema_of_variant(raw)
    return F.when(shape.startswith("OBJECT"), F.from_json(F.to_json(raw), PROPERTIES)).when(raw.isNull() | (shape == "VOID"), F.create_map().cast(PROPERTIES)).otherwise(F.create_map(F.lit("value"), F.coalesce(F.try_variant_get(v, "$.properties", "string"), F.to_json(raw))))


def parse_graph_json(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text) of graph documents to nodes and edges.

    ``edges`` may be called ``relationships``, ends ``from``/``start`` and ``to``/``end``, labels ``label``;
    ids default to the position; edges without both ends go.
    """
    graph = text.select(F.parse_json("text").alias("g"))
    good = graph.where(F.schema_of_variant("g").startswith("OBJECT"))
    nodes = good.select(F.posexplode(F.try_variant_get("g", "$.nodes", "array<variant>")).alias("pos", "n")).where(F.schema_of_variant("n").startswith("OBJECT"))
    labels = F.coalesce(F.try_variant_get("n", "$.labels", "array<string>"), F.array(_text("n", "$.labels", "$.label")))
    labels = F.filter(labels, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    out_nodes = nodes.select(
        F.coalesce(_text("n", "$.id", "$.neo4j_id"), F.concat(F.lit("node_"), F.col("pos").cast("string"))).alias("id"),
        F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("ImportedNode"))).alias("labels"),
        _properties("n").alias("properties"),
    )
    list_of = lambda name: F.try_variant_get("g", f"$.{name}", "array<variant>")
    every = F.when(F.size(F.coalesce(list_of("edges"), F.array().cast("array<variant>"))) > 0, list_of("edges")).otherwise(list_of("relationships"))
    edges = good.select(F.posexplode(every).alias("pos", "e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    out_edges = edges.select(
        F.coalesce(_text("e", "$.id", "$.neo4j_id"), F.concat(F.lit("edge_"), F.col("pos").cast("string"))).alias("id"),
        _text("e", "$.source", "$.from", "$.start").alias("source"),
        _text("e", "$.target", "$.to", "$.end").alias("target"),
        F.coalesce(_text("e", "$.type", "$.label"), F.lit("IMPORTED_RELATION")).alias("type"),
        _properties("e").alias("properties"),
    ).where("source is not null and target is not null")
    return out_nodes, out_edges


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_graph_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


DATA = "array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML files to nodes and edges. ``properties_json`` comes first; other data only fill gaps."""

    def rows(tag: str, attributes: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(f"{attributes}, data {DATA}").load(path)

    keys = spark.read.format("xml").option("rowTag", "key").option("ignoreNamespace", "true").schema("`_id` string, `_attr.name` string").load(path)
    # A file declares a handful of keys; they are looked up by name on the driver.
    names = {r[0]: r[1] or r[0] for r in keys.select("_id", "`_attr.name`").distinct().collect()}
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map().cast(PROPERTIES)
    data = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(DATA)), lambda d: F.struct(F.coalesce(F.try_element_at(lookup, d["_key"]), d["_key"]), F.coalesce(d["_VALUE"], F.lit("")))))
    empty = F.create_map().cast(PROPERTIES)

    def properties(drop: tuple[str, ...]) -> Column:
        packed = F.coalesce(F.from_json(F.try_element_at("d", F.lit("properties_json")), PROPERTIES), empty)
        rest = F.map_filter("d", lambda k, v: ~k.isin("properties_json", *drop) & ~F.map_contains_key(packed, k))
        return F.map_concat(packed, rest)

    nodes = rows("node", "`_id` string").select("_id", data.alias("d"))
    labels = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("d", F.lit("labels")), F.lit("")), ","), F.trim), lambda x: x != "")
    out_nodes = nodes.select(F.col("_id").alias("id"), F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("ImportedNode"))).alias("labels"), properties(("labels",)).alias("properties"))
    edges = rows("edge", "`_id` string, `_source` string, `_target` string, `_label` string").select("_id", "_source", "_target", "_label", data.alias("d"))
    out_edges = edges.select(
        F.coalesce("_id", F.concat(F.lit("edge_"), F.monotonically_increasing_id().cast("string"))).alias("id"),
        F.coalesce("_source", F.lit("")).alias("source"),
        F.coalesce("_target", F.lit("")).alias("target"),
        F.coalesce(F.nullif(F.try_element_at("d", F.lit("type")), F.lit("")), "_label", F.lit("IMPORTED_RELATION")).alias("type"),
        properties(("type",)).alias("properties"),
    )
    return out_nodes, out_edges


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """By extension: ``.json``, ``.graphml`` or ``.xml``."""
    name = path.lower()
    if name.endswith(".json"):
        return read_graph_json(spark, path)
    if name.endswith((".graphml", ".xml")):
        return read_graphml(spark, path)
    raise ValueError("only .json, .graphml and .xml are supported")


def export_subgraph(nodes: DataFrame, edges: DataFrame, contains: str = "", node_limit: int = 50_000, edge_limit: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes whose labels or properties hold a text, the edges among them, and a row of counts.

    An edge passes the filter by its type, its properties or those of a node at its ends; only such edges count for the
    limit and as skipped. The limits are the feature: an export for people. Nodes and edges are taken in order of id.
    """
    needle = contains.strip().lower()
    if needle:
        hit = lambda x: F.contains(F.lower(x), F.lit(needle))
        valued = F.coalesce(F.exists(F.map_values("properties"), lambda v: F.coalesce(hit(v), F.lit(False))), F.lit(False))
        named = nodes.where(valued).select("id").distinct()
        flags = [named.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("source", "target")]
        found = edges.withColumn("_own", F.coalesce(hit(F.col("type")), F.lit(False)) | valued).join(flags[0], "source", "left").join(flags[1], "target", "left")
        edges = found.where(F.col("_own") | F.col("_source").isNotNull() | F.col("_target").isNotNull()).drop("_own", "_source", "_target")
        nodes = nodes.where(F.exists("labels", hit) | valued)
    kept = nodes.orderBy("id").limit(node_limit)
    seen = edges.orderBy("id").limit(edge_limit)
    ids = kept.select(F.col("id").alias("source")).distinct()
    inside = seen.join(ids, "source", "left_semi").join(ids.withColumnRenamed("source", "target"), "target", "left_semi").select("id", "source", "target", "type", "properties")
    meta = kept.agg(F.count("*").alias("node_count")).join(inside.agg(F.count("*").alias("edge_count"))).join(seen.agg(F.count("*").alias("seen")))
    return kept, inside, meta.select("node_count", "edge_count", (F.col("seen") - F.col("edge_count")).alias("skipped_edges_outside_node_limit"), F.lit(node_limit).alias("node_limit"), F.lit(edge_limit).alias("relation_limit"), F.lit(contains).alias("filter"))


def json_lines(df: DataFrame) -> DataFrame:
    """A JSON object per row; write it with ``df.write.text``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def json_document(parts: dict[str, DataFrame | dict]) -> DataFrame:
    """One indented JSON document as ordered lines (part, ord, line): a list of a table's rows, or an object, by name.

    A row per element, so no task holds a list; rows come in order of ``id``. Write it sorted by (part, ord).
    """
    spark = next(p for p in parts.values() if isinstance(p, DataFrame)).sparkSession
    fixed, rows, last = [(0, 0, "{")], [], len(parts) - 1
    for k, (name, part) in enumerate(parts.items()):
        comma = "," if k < last else ""
        if not isinstance(part, DataFrame):
            text = json.dumps(part, ensure_ascii=False, indent=2).replace("\n", "\n  ")
            fixed.append((3 * k + 1, 0, f"  {json.dumps(name)}: {text}{comma}"))
            continue
        n = part.count()
        fixed += [(3 * k + 1, 0, f"  {json.dumps(name)}: ["), (3 * k + 3, 0, f"  ]{comma}")] if n else [(3 * k + 1, 0, f"  {json.dumps(name)}: []{comma}")]
        if n:
            value = F.concat(F.lit("    "), F.replace(canonical_json(F.to_json(F.struct(*part.columns), {"ignoreNullFields": "false"}), 2), F.lit("\n"), F.lit("\n    ")), F.when(F.col("ord") < n - 1, ",").otherwise(""))
            rows.append(numbered(part, ["id"], "ord", -1).select(F.lit(3 * k + 2).alias("part"), "ord", value.alias("line")))
    fixed.append((3 * last + 4, 0, "}"))
    out = spark.createDataFrame(fixed, "part int, ord long, line string")
    for r in rows:
        out = out.unionByName(r)
    return out


def graph_document(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """An exported graph (see :func:`export_subgraph`) as one indented JSON document, in ordered lines."""
    return json_document({"nodes": nodes.select("id", "labels", "properties"), "edges": edges.select("id", "type", "source", "target", "properties"), "meta": meta.first().asDict()})


def typed_properties(properties: Column) -> Column:
    """A VARIANT object as a map of VARIANTs: nulls go, names become identifiers, values keep their types.

    Lists of plain values lose their nulls; whatever is nested deeper becomes JSON text.
    """
    nested = lambda v: F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    empty = lambda v: v.isNull() | F.is_variant_null(v)
    text = lambda v: F.to_json(v).cast("variant")
    plain = lambda v: F.to_variant_object(F.filter(items(v), lambda x: ~empty(x)))
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    value = lambda v: F.when(is_list(v) & ~F.coalesce(F.exists(items(v), lambda x: ~empty(x) & nested(x)), F.lit(False)), plain(v)).when(nested(v), text(v)).otherwise(v)
    pairs = F.transform(F.map_entries(F.try_variant_get(properties, "$", "map<string,variant>")), lambda e: F.struct(identifier(e["key"], "property").alias("key"), e["value"].alias("value")))
    held = F.filter(pairs, lambda e: ~empty(e["value"]))
    names = F.array_distinct(F.transform(held, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(held, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], value(e["value"]).alias("value"))))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _json(properties: str) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(properties, F.create_map().cast(PROPERTIES))))
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), F.coalesce(quoted(e["value"]), F.lit("null")))), ", "), F.lit("}"))


def graphml_nodes(nodes: DataFrame) -> DataFrame:
    """Numbered nodes as GraphML elements: (ord, id, xml_id, xml)."""
    placed = numbered(nodes, ["id"], "ord", -1).withColumn("xml_id", F.concat(F.lit("n"), F.col("ord").cast("string")))
    label = F.coalesce(*(F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")) for k in ("name", "text", "norm")), F.col("xml_id"))
    data = lambda key, v: F.concat(F.lit(f'<data key="{key}">'), _xml(v), F.lit("</data>"))
    body = F.concat(data("neo4j_element_id", F.col("id")), data("label", label), data("labels", F.array_join("labels", ", ")), data("properties_json", _json("properties")))
    return placed.select("ord", "id", "xml_id", label.alias("label"), F.concat(F.lit('<node id="'), F.col("xml_id"), F.lit('">'), body, F.lit("</node>")).alias("xml"))


def graphml_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges as GraphML elements, with ``nodes`` numbered by :func:`graphml_nodes`; an edge without both ends keeps its number but is not written."""
    ends = nodes.select(F.col("id").alias("source"), F.col("xml_id").alias("s"))
    placed = numbered(edges, ["id"], "ord", -1).join(ends, "source").join(ends.withColumnsRenamed({"source": "target", "s": "t"}), "target")
    data = lambda key, v: F.concat(F.lit(f'<data key="{key}">'), _xml(v), F.lit("</data>"))
    body = F.concat(data("edge_neo4j_element_id", F.col("id")), data("type", F.col("type")), data("edge_properties_json", _json("properties")))
    head = F.concat(F.lit('<edge id="e'), F.col("ord").cast("string"), F.lit('" source="'), F.col("s"), F.lit('" target="'), F.col("t"), F.lit('">'))
    return placed.select("ord", F.concat(head, body, F.lit("</edge>")).alias("xml"))


# The attributes that the file format declares.
GRAPHML_KEYS = (
    ("neo4j_element_id", "node", "neo4j_element_id"),
    ("label", "node", "label"),
    ("labels", "node", "labels"),
    ("properties_json", "node", "properties_json"),
    ("edge_neo4j_element_id", "edge", "neo4j_element_id"),
    ("type", "edge", "type"),
    ("edge_properties_json", "edge", "properties_json"),
)


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A GraphML document as ordered lines (part, ord, line)."""
    spark = nodes.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{i}" for="{kind}" attr.name="{name}" attr.type="string"/>' for i, kind, name in GRAPHML_KEYS] + ['<graph id="G" edgedefault="directed">']
    fixed = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, ord int, line string")
    numbered = graphml_nodes(nodes)
    return fixed.unionByName(numbered.select(F.lit(1).alias("part"), "ord", F.col("xml").alias("line"))).unionByName(graphml_edges(edges, numbered).select(F.lit(2).alias("part"), "ord", F.col("xml").alias("line")))


def import_graph(nodes: DataFrame, edges: DataFrame, namespace: str, known_nodes: DataFrame | None = None, known_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upsert a graph under a namespace: the new nodes and edges with ``created`` flags, and a row of counts.

    Keys are ``namespace::id``; an edge without an id is known by its ends and type; edges whose ends are not
    imported are skipped and counted.
    """
    spark = nodes.sparkSession
    space = entity_name(F.lit(namespace or "imported_graph"))
    keyed = nodes.where("id is not null and id <> ''").select(F.concat(space, F.lit("::"), F.col("id")).alias("import_key"), F.array_distinct(F.concat(F.array(F.lit("ImportedGraphNode")), F.transform("labels", lambda x: identifier(x, "ImportedNode")))).alias("labels"), clean_properties("properties").alias("properties"))
    keyed = keyed.groupBy("import_key").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"), F.max_by("properties", F.size("properties")).alias("properties"))
    old = (known_nodes if known_nodes is not None else spark.createDataFrame([], "import_key string")).select("import_key", F.lit(True).alias("old"))
    new_nodes = materialize(keyed.join(old, "import_key", "left").withColumn("created", F.col("old").isNull()).drop("old"), "import")
    kind = relation_type(F.col("type"), "IMPORTED_RELATION")
    named = edges.select(
        F.concat(space, F.lit("::"), F.col("source")).alias("source_key"), F.concat(space, F.lit("::"), F.col("target")).alias("target_key"), kind.alias("type"), F.col("type").alias("import_type"),
        F.coalesce(F.nullif("id", F.lit("")), F.concat("source", F.lit("->"), "target", F.lit(":"), kind)).alias("import_id"), clean_properties("properties").alias("properties"),
    )
    ends = new_nodes.select(F.col("import_key").alias("source_key"))
    placed = named.join(ends, "source_key", "left_semi").join(ends.withColumnRenamed("source_key", "target_key"), "target_key", "left_semi").dropDuplicates(["source_key", "target_key", "type", "import_id"])
    keys = ["source_key", "target_key", "type", "import_id"]
    old = (known_edges if known_edges is not None else spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))).select(*keys, F.lit(True).alias("old"))
    new_edges = placed.join(old, keys, "left").withColumn("created", F.col("old").isNull()).drop("old")
    counts = new_nodes.agg(F.count_if("created").alias("created_nodes"), F.count_if(~F.col("created")).alias("updated_nodes")).join(
        new_edges.agg(F.count_if("created").alias("created_edges"), F.count("*").alias("kept"))).join(named.dropDuplicates(keys).agg(F.count("*").alias("every")))
    return new_nodes, new_edges, counts.select("created_nodes", "updated_nodes", "created_edges", (F.col("every") - F.col("kept")).alias("skipped_edges"))


def clean_properties(column: str) -> Column:
    """Property names as identifiers, null values dropped."""
    filled = F.map_filter(F.coalesce(column, F.create_map().cast(PROPERTIES)), lambda k, v: v.isNotNull())
    pairs = F.transform(F.map_entries(filled), lambda e: F.struct(identifier(e["key"], "property").alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["key"] == n), -1)))


def dot_text(edges: DataFrame, source: str = "source", target: str = "target", label: str = "type", size: int = 48) -> DataFrame:
    """One row ``dot``: a directed graph for drawing; a picture for people, so one string."""
    line = F.concat(F.lit('  "'), escape_dot(shorten(F.col(source), size)), F.lit('" -> "'), escape_dot(shorten(F.col(target), size)), F.lit('" [label="'), escape_dot(shorten(F.col(label), size)), F.lit('"];'))
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return edges.select(line.alias("line")).agg(F.concat(F.lit("digraph G {\n"), body, F.lit("\n}")).alias("dot"))
