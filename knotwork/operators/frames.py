"""Frames: recursive trees ``{text, frame: [...]}`` kept as VARIANT at the edge and as adjacency rows inside.

Spark's structs and expressions cannot recurse, so a tree is walked once, in Arrow batches, into a row per node;
what a node says is read from those rows with Spark's own functions. Trees of any depth take one pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_name, slot_text

NODE_NAMES = ["depth", "path", "parent_path", "ord", "node"]
NODE_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
NODES_AT_ONCE = 20_000


def role_frame(slot: Column) -> Column:
    """Any VARIANT slot as JSON of a frame: an object with text and frame stays whole, anything else gets an empty frame."""
    whole = F.schema_of_variant(slot).startswith("OBJECT") & F.try_variant_get(slot, "$.text", "variant").isNotNull() & F.try_variant_get(slot, "$.frame", "variant").isNotNull()
    plain = F.concat(F.lit('{"frame":[],"text":'), F.to_json(F.parse_json(F.concat(F.lit('"'), _quoted(slot_text(slot)), F.lit('"')))), F.lit("}"))
    return F.when(whole, F.to_json(slot)).otherwise(plain)


def _quoted(text: Column) -> Column:
    """The inside of a JSON string."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for plain, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def walk(tree: Any) -> Iterator[tuple[int, str, str | None, int, str]]:
    """(depth, path, parent's path, ord, JSON without children) of each node, parents before children."""
    stack: list[tuple[Any, int, str, str | None, int]] = [(tree, 0, "0", None, 0)]
    while stack:
        node, depth, path, parent, at = stack.pop()
        own, children = node, None
        if isinstance(node, dict):
            own, children = {k: v for k, v in node.items() if k != "frame"}, node.get("frame")
        yield depth, path, parent, at, json.dumps(own, ensure_ascii=False)
        if isinstance(children, list):
            stack += [(c, depth + 1, f"{path}.{k}", path, k) for k, c in reversed(list(enumerate(children)))]


def flatten(trees: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, depth, path, parent_path, ord, text, norm, lemma, edge_label, is_root) in rows, a row per node.

    Paths are dotted positions from ``0``; a child without text is kept. Null trees have no node.
    """
    rows = trees.where(F.col(frame).isNotNull()).select(*keys, F.to_json(frame).alias("_tree"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, owner: list[int], found: list[tuple]) -> pa.RecordBatch:
            mine = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*mine, *(pa.array(c, t) for c, t in zip(zip(*found), NODE_TYPES, strict=True))], names=[*keys, *NODE_NAMES])

        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                for node in walk(json.loads(text)):
                    owner.append(i)
                    found.append(node)
                    if len(found) >= NODES_AT_ONCE:
                        yield out(batch, owner, found)
                        owner, found = [], []
            if found:
                yield out(batch, owner, found)

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "depth int, path string, parent_path string, ord int, node string"])
    nodes = rows.mapInArrow(run, ddl).withColumn("node", F.parse_json("node"))
    return nodes.select(
        *keys, "depth", "path", "parent_path", "ord", slot_text(F.col("node")).alias("text"), F.try_variant_get("node", "$.lemma", "string").alias("lemma"), F.nullif(slot_text(F.try_variant_get("node", "$.edge_label", "variant")), F.lit("")).alias("edge_label"), (F.col("depth") == 0).alias("is_root"),
    ).withColumn("norm", entity_name(F.col("text"))).select(*keys, "depth", "path", "parent_path", "ord", "text", "norm", "lemma", "edge_label", "is_root")


def frame_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Parent-child edges of flattened trees."""
    return nodes.where("parent_path is not null").select(*keys, F.col("parent_path").alias("src"), F.col("path").alias("dst"), "ord")


def fold(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """By tree: nodes with text, the set of texts, and whether there is any content."""
    full = F.col("text") != ""
    return nodes.groupBy(*keys).agg(F.count_if(full).alias("nodes"), F.array_sort(F.collect_set(F.when(full, F.col("text")))).alias("texts"), F.bool_or(full).alias("has_content"))


def natural(path: Column) -> Column:
    """Sort key under which ``0.2`` comes before ``0.10``."""
    return F.transform(F.split(path, "\\."), lambda x: x.cast("int"))


def frame_tree(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with their parent's text, in natural order of paths."""
    parents = nodes.select(*keys, F.col("path").alias("parent_path"), F.col("text").alias("parent_text"))
    return nodes.join(parents, [*keys, "parent_path"], "left").select(*keys, "depth", "path", "text", "parent_path", "parent_text").distinct().orderBy(*keys, "depth", natural(F.col("path")))


def subtree(nodes: DataFrame, keys: list[str], root_path: str) -> DataFrame:
    """A node and all below it, by path prefix."""
    return nodes.where((F.col("path") == root_path) | F.col("path").startswith(root_path + "."))


def frame_terms(nodes: DataFrame) -> DataFrame:
    """(triplet_id, role, term): texts and norms of all nodes of a role's frame."""
    return nodes.select("triplet_id", "role", F.explode(F.array("text", "norm")).alias("term")).where("term <> ''").distinct()


def node_rows(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """Flattened nodes as rows of the store's node table, ids apart: instances give frame_instance_id. The lemma is the text."""
    placed = nodes.join(instances.select("triplet_id", "role", F.col("id").alias("frame_instance_id")), ["triplet_id", "role"])
    return placed.select("frame_instance_id", "parent_path", F.col("text").alias("node_text"), F.col("norm").alias("node_norm"), F.col("text").alias("node_lemma"), "edge_label", "depth", "path", "ord", "is_root")


def normalize_slots(inner: DataFrame, keys: list[str], role: str) -> DataFrame:
    """One frame per slot out of several inner triplets.

    ``inner``: keys, position, text, frame (array of strings: texts of the children), nodes (count),
    all_texts (array). The anchor is the one with most nodes (first on ties); the others' texts follow as
    children unless the anchor's tree holds them already.
    """
    full = inner.where("text <> ''")
    anchor = full.groupBy(*keys).agg(F.max_by(F.struct("position", "text", "frame", "all_texts"), F.struct("nodes", -F.col("position"))).alias("a"))
    others = full.join(anchor, keys).where((F.col("position") != F.col("a.position")) & ~F.array_contains("a.all_texts", F.col("text")))
    extra = others.groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])).alias("extra"))
    return anchor.join(extra, keys, "left").select(*keys, F.lit(role).alias("role"), F.col("a.text").alias("text"), F.concat("a.frame", F.coalesce("extra", F.array().cast("array<string>"))).alias("frame"))
