"""Merkle manifest of a dataset, with an inclusion proof for every row.

A row's leaf is the hash of its fields. The leaves of a source, in order of doc_id, are reduced in runs of 16 until
one node is left, the source's subroot; the subroots, in order of their sources, likewise give the root.

Blocks of 16**3 leaves, whose places come from a range sort and counts per partition, are reduced in parallel to a
node each. The driver reduces what is left, at most ``TOP`` nodes, and broadcasts each block's suffix path: its
siblings from there up to the root. Where more are left, they are reduced by blocks in turn first (once each source
is down to one node, all subroots are one tree), and the suffix paths come down the same way, by joins. Executors
then go through the blocks again: a row's proof is its siblings within the block and the block's suffix, and its fold
hashes a leaf with these up to the root.

All hashes are lowercase hex SHA-256 and enter other hashes as hex text. A field is ``-`` if null, else its UTF-8
byte count, ``:`` and its value.

Defined results: equal rows have equal leaves next to each other, each with a proof of its own; null ids come first
in their source, repeated ids follow in order of their leaves; a null source is a source of its own, the first;
missing columns count as null, further ones are ignored; an empty table has no row; a row without an id is never
tampered with in the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_key, sequenced

FANOUT = 16
LEVELS = 3  # that a block reduces: 4,096 leaves
TOP = 4096  # nodes that the driver reduces; a suffix path is some kilobytes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The siblings of a node level by level: those left of it and those right of it, each as one string of hex digits.
Path = list[tuple[bytes, bytes]]


def H(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def levels_of(nodes: list[bytes], most: int | None) -> list[list[bytes]]:
    """The levels over some nodes, up to the one node that is left or after ``most`` reductions."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        last = out[-1]
        out.append([H(b"".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def path_of(levels: list[list[bytes]], at: int) -> Path:
    out = []
    for level in levels[:-1]:
        a = at - at % FANOUT
        out.append((b"".join(level[a:at]), b"".join(level[at + 1 : a + FANOUT])))
        at //= FANOUT
    return out


def folded(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = H(left + leaf + right)
    return leaf


def proof_hash(path: Path) -> bytes:
    return H(b"".join(left + right for left, right in path))


def leaf_hash(columns: dict[str, Column]) -> Column:
    fields = []
    for name in FIELDS:
        value = columns[name].cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


NODES_DDL = "tree string, place long, node string"
SUFFIX_DDL = "tree string, place long, path array<struct<left:string,right:string>>, subroot string, root string"
SUFFIX = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / FANOUT**levels).alias("block")


def _encoded(table: pa.Table, *columns: str) -> list[list[bytes]]:
    """Columns of a block in order of place, texts as bytes."""
    table = table.sort_by("place")
    return [table.column(c).cast(pa.binary()).to_pylist() for c in columns]


def _depth(n: int, levels: int) -> int | None:
    """How many levels a block of a tree of n nodes reduces: all, if the tree is no larger than a block."""
    return None if n <= FANOUT**levels else levels


def reduce_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, place, node, n (nodes of the tree): to the nodes of the blocks, alike."""

    def run(key, table):
        hashes, n = _encoded(table, "node")[0], table.column("n")[0].as_py()
        left = -(-n // FANOUT**levels)
        top = levels_of(hashes, _depth(n, levels))[-1][0]
        return pa.Table.from_pydict({"tree": [key[0].as_py()], "place": [key[1].as_py()], "node": [top.decode()], "n": [left]})

    return nodes.groupBy("tree", _block(levels)).applyInArrow(run, NODES_DDL + ", n long")


def top_paths(rows: list[tuple[str, int, bytes]]) -> dict[tuple[str, int], tuple[Path, bytes, bytes]]:
    """Of the nodes left, by tree and place: path to the root, subroot, root."""
    trees: dict[str, list[tuple[int, bytes]]] = {}
    for tree, place, node in rows:
        trees.setdefault(tree, []).append((place, node))
    order = sorted(trees, key=str.encode)
    own = [levels_of([node for _, node in sorted(trees[t])], None) for t in order]
    upper = levels_of([x[-1][0] for x in own], None)
    root = upper[-1][0] if own else b""
    return {(t, p): (path_of(own[k], p) + path_of(upper, k), own[k][-1][0], root) for k, t in enumerate(order) for p in range(len(own[k][0]))}


def suffix_paths(nodes: DataFrame, levels: int, top: int) -> dict | DataFrame:
    """The nodes' paths to the root: a dictionary where there are at most ``top`` nodes, else a table."""
    total, most = nodes.agg(F.count("*"), F.max("n")).first()
    if total <= top:
        return top_paths([(t, p, node.encode()) for t, p, node in nodes.select("tree", "place", "node").collect()])
    if most > 1:  # trees of several nodes: another round of blocks
        upper = materialize(reduce_blocks(nodes, levels), "nodes")
        return materialize(_down(nodes, suffix_paths(upper, levels, top), levels, _suffix_rows, SUFFIX_DDL), "suffixes")
    # Every source is one node, and there are many: their subroots are one tree.
    ranked, _ = sequenced(nodes.select(F.col("tree").alias("source"), "node", F.lit("").alias("tree")), "tree", ["source"])
    ranked = materialize(ranked.withColumn("n", F.lit(total)), "subroots")
    paths = suffix_paths(materialize(reduce_blocks(ranked, levels), "nodes"), levels, top)
    found = _down(ranked, paths, levels, _suffix_rows, SUFFIX_DDL).withColumnRenamed("place", "_place").drop("tree", "subroot")
    own = ranked.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("place").alias("_place"), F.col("node").alias("subroot"))
    return materialize(own.join(found, "_place").select("tree", "place", "path", "subroot", "root"), "suffixes")


def _suffix_rows(table: pa.Table, tree: str, hashes: list[bytes], paths: Iterator[Path], subroot: bytes, root: bytes) -> pa.Table:
    at = sorted(table.column("place").to_pylist())
    as_text = [[{"left": a.decode(), "right": b.decode()} for a, b in p] for p in paths]
    n = len(at)
    return pa.Table.from_arrays([pa.array([tree] * n), pa.array(at, pa.int64()), pa.array(as_text, SUFFIX.field("path").type), pa.array([subroot.decode()] * n), pa.array([root.decode()] * n)], schema=SUFFIX)


def _down(nodes: DataFrame, suffixes: dict | DataFrame, levels: int, finish, ddl: str) -> DataFrame:
    """Blocks and the suffix paths of their nodes, to ``finish(block's rows, tree, nodes, their paths, subroot, root)``."""

    def rows(table: pa.Table, tree: str, place: int, path: Path, subroot: bytes, root: bytes) -> pa.Table:
        hashes = _encoded(table, "node")[0]
        inner = levels_of(hashes, _depth(table.column("n")[0].as_py(), levels))
        return finish(table, tree, hashes, (path_of(inner, i) + path for i in range(len(hashes))), subroot, root)

    grouped = nodes.groupBy("tree", _block(levels))
    if isinstance(suffixes, dict):
        shared = nodes.sparkSession.sparkContext.broadcast(suffixes)

        def by_broadcast(key, table):
            at = key[0].as_py(), key[1].as_py()
            return rows(table, *at, *shared.value[at])

        return grouped.applyInArrow(by_broadcast, ddl)

    def by_join(key, table, suffix):
        found = suffix.to_pylist()[0]
        path = [(s["left"].encode(), s["right"].encode()) for s in found["path"]]
        return rows(table, key[0].as_py(), key[1].as_py(), path, (found["subroot"] or "").encode(), found["root"].encode())

    return grouped.cogroup(suffixes.groupBy("tree", F.col("place").alias("block"))).applyInArrow(by_join, ddl)


def _placed(docs: DataFrame, candidate: Column | None, levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaves at their places in the sources' trees, and the nodes of their blocks. ``candidate``: see :func:`verify`."""
    there = {name: F.col(name) if name in docs.columns else F.lit(None).cast("string") for name in FIELDS}
    there |= {"doc_id": there["doc_id"].cast("long"), "n_chars": there["n_chars"].cast("long")}
    leaf = leaf_hash(there)
    changed = F.when(candidate.isNull(), leaf).otherwise(leaf_hash(there | {"text": candidate})) if candidate is not None else leaf
    source = there["source"].cast("string")
    leaves = docs.select(there["doc_id"].alias("doc_id"), source.alias("source"), leaf.alias("node"), changed.alias("candidate"), group_key(source).alias("tree"))
    rows, groups = sequenced(leaves, "tree", ["doc_id", "node"])
    nodes = rows.join(groups.select("tree", "n"), "tree")
    return nodes, materialize(reduce_blocks(nodes, levels), "nodes")


def verify(docs: DataFrame, candidate: Column | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    The fold starts from the row with the text ``candidate`` (where that is not null) instead of its own, and takes
    the siblings of the original tree.
    """
    nodes, blocks = _placed(docs, candidate, levels)
    names = ("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

    def finish(table: pa.Table, tree: str, hashes: list[bytes], paths: Iterator[Path], subroot: bytes, root: bytes) -> pa.Table:
        table, proofs, folds = table.sort_by("place"), [], []
        for start, path in zip(table.column("candidate").cast(pa.binary()).to_pylist(), paths, strict=True):
            proofs.append(proof_hash(path).decode())
            folds.append(folded(start, path))
        n = len(proofs)
        columns = [table.column("doc_id"), table.column("source"), table.column("node"), [subroot.decode()] * n, [root.decode()] * n, proofs, [f.decode() for f in folds], [f == root for f in folds]]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], names=names)

    ddl = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _down(nodes, suffix_paths(blocks, levels, top), levels, finish, ddl)


def proofs(docs: DataFrame, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, and path: the siblings left and right of it, level by level."""
    nodes, blocks = _placed(docs, None, levels)

    def finish(table: pa.Table, tree: str, hashes: list[bytes], paths: Iterator[Path], subroot: bytes, root: bytes) -> pa.Table:
        table, own = table.sort_by("place"), _suffix_rows(table, tree, hashes, paths, subroot, root)
        return pa.Table.from_arrays([table.column("doc_id"), table.column("source"), table.column("node"), own.column("subroot"), own.column("root"), own.column("path")], names=["doc_id", "source", "leaf", "subroot", "root", "path"])

    return _down(nodes, suffix_paths(blocks, levels, top), levels, finish, "doc_id long, source string, leaf string, subroot string, root string, path array<struct<left:string,right:string>>")


def tampered(docs: DataFrame) -> Column:
    """The query's change: texts of rows whose id's CRC-32 is divisible by 5, with A-Z in lower case."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(5)) == 0
    return F.when(hit, F.translate(F.col("text").cast("string"), UPPER, LOWER))


def digest(verified: DataFrame) -> DataFrame:
    """The columns of the query."""
    return verified.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
