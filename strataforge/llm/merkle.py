"""Operator 11: a Merkle manifest of a dataset with an authentication path for each row."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.ranks import numbered
from strataforge.session import staged

#: Nodes that become one, levels of an aligned block, which has ``ARITY ** LEVELS`` leaves.
ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def field(c: Column) -> Column:
    """A value's bytes in a leaf: ``-`` if null, else its length in bytes, ``:`` and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def node_of(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


class Treehash:
    """Nodes of one level, made from consecutive leaves with fewer than ``ARITY`` pending nodes on each level below."""

    def __init__(self, level: int, at: int, stop: int) -> None:
        self.level, self.at, self.stop = level, at, stop
        self.pending: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def _put(self, level: int, node: str) -> None:
        while level < self.level:
            run = self.pending[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node = node_of(run)
            run.clear()
            level += 1
        self.nodes.append(node)

    def step(self, leaves: list[str]) -> None:
        """Takes one leaf; after the last one a shorter run on any level is closed."""
        if self.at < self.stop:
            self._put(0, leaves[self.at])
            self.at += 1
        if self.at == self.stop == len(leaves):
            for level in range(self.level):
                if self.pending[level]:
                    node = node_of(self.pending[level])
                    self.pending[level].clear()
                    self._put(level + 1, node)

    def done(self) -> bool:
        return self.at >= self.stop

    def lowest(self) -> int:
        """The level of the lowest pending node; its own level before the first leaf."""
        return next((k for k, run in enumerate(self.pending) if run), self.level)

    def held(self) -> int:
        return len(self.nodes) + sum(map(len, self.pending))


def height_of(leaves: int) -> int:
    h = 0
    while ARITY**h < leaves:
        h += 1
    return h


def block_root(leaves: list[str], height: int) -> str:
    tree = Treehash(height, 0, len(leaves))
    for _ in leaves:
        tree.step(leaves)
    return tree.nodes[0]


class Traversal:
    """Authentication paths of a block, leaf by leaf.

    Each level holds the run of nodes that the current leaf's path lies in, and a
    treehash that makes the level's next run meanwhile. A step to the
    next leaf has as many units of work, of one leaf each, as there are levels; each unit goes to the unfinished treehash
    whose lowest pending node is lowest, so that few are under way at a time. What is held are these runs and pending nodes: a number
    that grows with the block's height, not with its leaves.
    """

    def __init__(self, leaves: list[str], height: int) -> None:
        self.leaves, self.height, self.at = leaves, height, 0
        self.runs = [self._run(h, 0) for h in range(height)]
        for h, run in enumerate(self.runs):
            self._finish(run)
            self.runs[h] = run.nodes
        self.next = [self._run(h, 1) for h in range(height)]

    def _run(self, level: int, k: int) -> Treehash:
        size = ARITY ** (level + 1)
        return Treehash(level, min(k * size, len(self.leaves)), min((k + 1) * size, len(self.leaves)))

    def _finish(self, tree: Treehash) -> None:
        while not tree.done():
            tree.step(self.leaves)

    def path(self) -> list[tuple[str, str]]:
        """What stands left and right of the node on each level from the leaf up."""
        out, at = [], self.at
        for run in self.runs:
            k = at % ARITY
            out.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at //= ARITY
        return out

    def advance(self) -> None:
        for _ in range(self.height):
            open_ = [t for t in self.next if not t.done()]
            if not open_:
                break
            min(open_, key=lambda t: (t.lowest(), t.level)).step(self.leaves)
        self.at += 1
        for h in range(self.height):
            size = ARITY ** (h + 1)
            if self.at % size:
                break
            self._finish(self.next[h])
            self.runs[h] = self.next[h].nodes
            self.next[h] = self._run(h, self.at // size + 1)

    def held(self) -> int:
        return sum(map(len, self.runs)) + sum(t.held() for t in self.next)


def _block_height(block: int, leaves: int, levels: int) -> int:
    """A block that is alone in its tree ends at its single node; one of several reaches the full height. Only the last is not full, so the first one is alone if it is not full."""
    return levels if block > 0 else height_of(leaves)


def _leaves(table: pa.Table) -> tuple[pa.Table, list[str]]:
    table = table.take(pc.sort_indices(table["pos"]))
    return table, table["node"].to_pylist()


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY**levels}")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``(tree, pos, node)``: the root of each aligned block, numbered by block."""

    def root(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, leaves = _leaves(table)
        return pa.table({"tree": table["tree"].slice(0, 1), "pos": pa.array([block], pa.int64()), "node": [block_root(leaves, _block_height(block, len(leaves), levels))]})

    return nodes.select("tree", _block(levels).alias("block"), "pos", "node").groupBy("tree", "block").applyInArrow(root, "tree string, pos bigint, node string")


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Roots of the blocks, roots of the blocks of these, and so on to one node a tree."""
    layers = [staged(_roots(nodes, levels), "block-roots")]
    while layers[-1].where("pos > 0").limit(1).count():
        layers.append(staged(_roots(layers[-1], levels), "block-roots"))
    return layers


def _walk(nodes: DataFrame, shared: DataFrame, levels: int) -> DataFrame:
    """Each block's nodes with their paths in the block, then the path that they share above it."""
    kept = nodes.columns
    nodes = nodes.withColumn("block", _block(levels))

    def walk(table: pa.Table, shared: pa.Table) -> pa.Table:
        table, leaves = _leaves(table)
        block = table["block"][0].as_py()
        steps = Traversal(leaves, _block_height(block, len(leaves), levels))
        above = [(s["left"], s["right"]) for s in shared["above"][0].as_py()]
        left, right, ends = [], [], [0]
        for _ in leaves:
            for a, b in (*steps.path(), *above):
                left.append(a)
                right.append(b)
            ends.append(len(left))
            steps.advance()
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"]))
        table = table.select(kept).append_column("path", path)
        for c in ("subroot", "root"):
            table = table.append_column(c, pa.repeat(shared[c][0], len(leaves)))
        return table

    schema = ", ".join([f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in kept] + [f"path array<{STEP}>", "subroot string", "root string"])
    return nodes.groupBy("tree", "block").cogroup(shared.groupBy("tree", "block")).applyInArrow(walk, schema)


def _alone(tops: DataFrame) -> DataFrame:
    return tops.select("tree", F.expr(f"cast(array() as array<{STEP}>)").alias("above"), F.col("node").alias("root"))


def authenticated(nodes: DataFrame, over: Callable[[DataFrame], DataFrame] = _alone, levels: int = LEVELS) -> DataFrame:
    """``nodes(tree, pos, node, ...)`` with ``path``, ``subroot`` and ``root``: a tree over the nodes of each ``tree`` in the order of ``pos`` = 0, 1, ...

    ``path`` lists what stands left and right of the node on each level. ``tree``, ``pos`` and ``node`` are not null.
    A single node is its own root, with an empty path. ``over`` takes ``(tree, node)``, the root of each tree, and gives
    ``(tree, above, root)``, the path that goes on above it. Aligned blocks of ``ARITY ** levels`` nodes are reduced to their roots,
    these to the roots of blocks of blocks, and so on while any tree has more than one; then paths come
    down again, each block's rows with the path that they share above the block. No step has more than a block's rows
    in one place.
    """
    layers = _layers(nodes, levels)
    tops = layers[-1]
    shared = tops.join(over(tops.select("tree", "node")), "tree").select("tree", F.col("pos").alias("block"), "above", F.col("node").alias("subroot"), "root")
    for layer in reversed(layers[:-1]):
        shared = staged(_walk(layer, shared, levels), "block-paths").select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
    return _walk(nodes, shared, levels)


def _over_sources(tops: DataFrame, levels: int) -> DataFrame:
    """The tree over the sources' roots, in the order of their names."""
    named = numbered(tops.select(F.col("tree").alias("name"), "node", F.lit("").alias("tree")), [F.col("name")], "pos")
    found = authenticated(staged(named.withColumn("pos", F.col("pos") - 1), "numbered-subroots"), levels=levels)
    return staged(found.select(F.col("name").alias("tree"), F.col("path").alias("above"), "root"), "top-paths")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def merkle_manifest(docs: DataFrame, changed: Column | None = None, changes: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """``(doc_id, source, leaf, other, subroot, root, path)``: one row for each row of ``docs``, with the path from its leaf to the root.

    A leaf is the digest of the row's fields ``doc_id, source, lang, n_chars, text``. The leaves of a source ascend by id (null ids first,
    rows that repeat an id by leaf, in any order where leaves are equal too); rows without a source
    are a source of their own, the first. ``other`` is the leaf that the row would have
    with the fields of ``changes`` where ``changed`` holds, else ``leaf``. Extra
    columns are ignored; an empty table gives an empty result. Texts are
    hashed where they are read; only digests move.
    """
    rows = docs.select(*FIELDS)
    altered = [(changes or {}).get(c, F.col(c)) for c in FIELDS]
    leaf = leaf_of([F.col(c) for c in FIELDS])
    tree = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    other = F.unhex(F.when(changed, leaf_of(altered))) if changed is not None else F.lit(None).cast("binary")
    leaves = staged(rows.select("doc_id", tree.alias("tree"), F.unhex(leaf).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("place")), "leaves")
    placed = staged(numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("place")], "pos", ["tree"]), "numbered-leaves")
    digest = lambda c: F.lower(F.hex(c))
    nodes = placed.select("tree", (F.col("pos") - 1).alias("pos"), digest("leaf").alias("node"), "doc_id", F.when(F.col("other").isNotNull(), digest("other")).alias("other"))
    found = authenticated(nodes, lambda tops: _over_sources(tops, levels), levels)
    source = F.when(F.col("tree") != "-", F.expr("substring(tree, 2)"))
    return found.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), F.coalesce("other", "node").alias("other"), "subroot", "root", "path")


def manifest_digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest's digests, and how it answers texts whose line feeds were deleted in rows where 2 divides the id's CRC-32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = merkle_manifest(docs, even & F.contains(F.col("text"), F.lit("\n")), {"text": cut}, levels)
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded(F.col("other"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
