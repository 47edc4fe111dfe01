"""Embedding near-duplicates with a forest of random-projection trees.

Vectors of one label (and length) start at the root of each tree. A node of more than
`LEAF` vectors projects them on a random direction and splits them at the median; those
within a margin of the split go to both sides, so that close vectors are seldom parted.
Medians come from mergeable sketches, so a node of any size is split by all tasks
together. Within leaves all vectors are compared exactly, in double precision; links
found in any tree are united and make components.

Equal vectors are one vector with a count. The margin is never narrowed: a node that it
does not split well, as too many of its vectors would go to both sides, is compared in
blocks of bounded size instead: exact as well. Nothing is sampled; the depth of the
trees grows with a label's vectors, and so does their number.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without label, are linked with nothing; vectors of different
lengths are not compared; a repeated row is another vector; a null vec_id is the
largest; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, table
from plumbline.llm.components import components

TREES = 4
LEAF = 1024
#: Margin in standard deviations of the projected difference of two vectors that just link.
SPILL = 0.65
#: Shares of a node that its children may reach over the median; two children beyond that have as many pairs as the node.
OVERLAP = 0.2
#: A child with more than this share of its parent's vectors is compared in blocks.
STALLED = 0.8
LEVELS = 60
BROADCAST_NODES = 200_000
_NULL_ID = (1 << 63) - 1


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors, in double precision, of the vectors of each length. The first byte says how components are kept: as given, 4 or 8 bytes each."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, sizes = np.frombuffer(column.buffers()[2], np.uint8), np.diff(ends)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        if len(places) == len(column):
            raw = data[ends[0] : ends[-1]].reshape(len(column), size)
        else:
            raw = data[ends[places][:, None] + np.arange(size)]
        kind = np.float32 if raw[0, :1].tobytes() == b"4" else np.float64
        vectors = np.ascontiguousarray(raw[:, 8:]).view(kind).astype(np.float64)
        vectors /= np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        yield places, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column whose vectors have one length, as those of a node have."""
    return next(_by_length(column))[1]


def _projected(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The rows (path, node, copies, vector, n, size), of which the columns `kept`, with their projection on their node's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            paths = batch.column(0).to_numpy()
            values, sizes = np.zeros(len(paths)), np.zeros(len(paths), np.int64)
            for places, vectors in _by_length(batch.column(3)):
                length = vectors.shape[1]
                order = np.argsort(paths[places], kind="stable")
                cuts = np.flatnonzero(np.diff(paths[places][order])) + 1
                for some in np.split(order, cuts):
                    key = (int(paths[places[some[0]]]), length)
                    if key not in directions:
                        if len(directions) > 20_000:
                            directions.clear()
                        drawn = np.random.default_rng(key[0] & 0xFFFFFFFFFFFFFFFF).standard_normal(length)
                        directions[key] = drawn / np.linalg.norm(drawn)
                    values[places[some]] = vectors[some] @ directions[key]
                sizes[places] = length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values), pa.array(sizes)], [*kept, "at", "dimensions"])

    kinds = ", ".join(f"{c} {'binary' if c == 'vector' else 'long'}" for c in kept)
    return rows.select("path", "node", "copies", "vector", "n", "size").mapInArrow(run, f"{kinds}, at double, dimensions long")


def _children(placed: DataFrame) -> DataFrame:
    """Rows of nodes that are split, in their child nodes: path, node, copies, vector, size (of the parent)."""
    left = F.col("at") <= F.col("q")[1] + F.col("margin")
    right = F.col("at") > F.col("q")[1] - F.col("margin")
    sides = F.array_compact(F.array(F.when(left, F.lit(1)), F.when(right | ~left, F.lit(2))))
    return placed.withColumn("side", F.explode(sides)).select(
        F.xxhash64("path", "side").alias("path"), "node", "copies", "vector", F.col("n").alias("size")
    )


def _link_batch(nodes: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    swap = nodes[left] > nodes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (nodes[left], nodes[right], copies[left], copies[right])], ["a", "b", "of_a", "of_b"]
    )


_LINK = "a long, b long, of_a long, of_b long"


def _linked_in_leaves(leaves: DataFrame, cosine: float) -> DataFrame:
    """All links within each leaf."""

    def links(nodes: np.ndarray, copies: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(nodes) < 2:
            return
        left, right = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
        for at in range(0, len(left), 50_000):
            yield _link_batch(nodes, copies, left[at : at + 50_000], right[at : at + 50_000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, ([], [], [])
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(0).to_numpy()
            nodes, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = np.r_[0, np.flatnonzero(paths[1:] != paths[:-1]) + 1, len(paths)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if paths[start] != path:
                    if held[0]:
                        yield from links(*map(np.concatenate, held))
                    path, held = paths[start], ([], [], [])
                held[0].append(nodes[start:end])
                held[1].append(copies[start:end])
                held[2].append(_units(batch.column(3).slice(start, end - start)))
        if held[0]:
            yield from links(*map(np.concatenate, held))

    return leaves.select("path", "node", "copies", "vector").repartition("path").sortWithinPartitions("path").mapInArrow(run, _LINK)


def _linked_in_blocks(stalled: DataFrame, cosine: float) -> DataFrame:
    """All links within nodes of any size (column n): every pair of blocks of the node is a task's group."""
    blocks = f"int(ceil(n / {LEAF}))"
    rows = stalled.withColumn("block", F.expr(f"pmod(xxhash64(31, node), {blocks})"))
    pairs = rows.withColumn("other", F.explode(F.expr(f"sequence(0L, {blocks} - 1L)"))).select(
        "path", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "copies", "vector", "block"
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        unit = _units(group.column("vector").chunk(0))
        same = group.column("one")[0] == group.column("two")[0]
        alike = np.triu(unit @ unit.T >= cosine, 1)
        if not same:
            alike &= block[:, None] != block[None, :]
        return pa.Table.from_batches([_link_batch(nodes, copies, *np.nonzero(alike))])

    return pairs.groupBy("path", "one", "two").applyInArrow(compare, _LINK)


def links(vectors: DataFrame, cosine: float, trees: int, seed: int) -> DataFrame:
    """Links a < b of vectors (node, root, copies, vector), with the copies of both.

    A root that is no leaf has `trees` trees, and one more for every two halvings that lead to a leaf. A leaf needs one.
    """
    large = cut(vectors.groupBy("root").agg(F.count("*").alias("of_root")).filter(F.col("of_root") > LEAF))
    own = vectors.join(F.broadcast(large) if large.count() <= BROADCAST_NODES else large, "root", "left")
    more = F.ceil(F.log2(F.col("of_root") / LEAF) / 2).cast("int")
    roots = F.explode(F.sequence(F.lit(1), F.coalesce(F.lit(trees) + more, F.lit(1))))
    rows = own.withColumn("tree", roots).select(
        F.xxhash64(F.lit(seed), "tree", "root").alias("path"), "node", "copies", "vector", F.lit(None).cast("long").alias("size")
    )
    found = []
    for level in range(LEVELS):
        rows = cut(rows)
        large = cut(rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF))
        n_large = large.count()
        # Few large nodes are sent to all tasks; many are joined by shuffle.
        sent = F.broadcast if n_large <= BROADCAST_NODES else lambda nodes: nodes
        marked = rows.join(sent(large), "path", "left")
        found.append(_linked_in_leaves(marked.filter("n IS NULL"), cosine))
        if not n_large:
            break
        # Two unit vectors of this cosine are sqrt(2 - 2 cosine) apart.
        margin = F.lit(SPILL * (2 - 2 * cosine) ** 0.5) / F.sqrt(F.col("dimensions"))
        reach = F.least(F.col("q")[2] - F.col("q")[1], F.col("q")[1] - F.col("q")[0])
        is_stalled = (reach < F.col("margin")) | F.coalesce(F.col("n") > STALLED * F.col("size"), F.lit(False))
        if level == LEVELS - 1:
            is_stalled = F.lit(True)
        split = marked.filter("n IS NOT NULL")
        quantiles = F.percentile_approx("at", [0.5 - OVERLAP, 0.5, 0.5 + OVERLAP], 1000).alias("q")
        nodes = _projected(split, ["path", "n", "size"]).groupBy("path").agg(quantiles, *[F.first(c).alias(c) for c in ("n", "size", "dimensions")])
        nodes = cut(nodes.withColumn("margin", margin).select("path", "q", "margin", is_stalled.alias("is_stalled")))
        stalled = nodes.filter("is_stalled").select("path")
        n_stalled = stalled.count()
        if n_stalled:
            found.append(_linked_in_blocks(split.join(sent(stalled), "path", "left_semi"), cosine))
        if n_stalled == n_large:
            break
        split = split.join(sent(nodes.filter("NOT is_stalled").select("path")), "path", "left_semi") if n_stalled else split
        rows = _children(_projected(split, ["path", "node", "copies", "vector", "n"]).join(sent(nodes), "path"))
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    return pairs.distinct()


def near_vectors(
    rows: DataFrame,
    *,
    cosine: float = 0.93,
    trees: int = TREES,
    seed: int = 1,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reachable) and kept (vec_id = component_id) of every row."""
    whole = rows.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    fine = F.expr(
        "label IS NOT NULL AND coalesce(forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
        "AND exists(vector, x -> x <> 0), false)"
    )
    whole = cut(
        whole.withColumn("node", F.when(fine, F.xxhash64(F.lit(1), "label", "vector"))).withColumn("root", F.xxhash64(F.lit(2), "label", F.size("vector")))
    )

    # Components are kept as they were given.
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    head, kind = (b"4" if single else b"8").ljust(8), np.float32 if single else np.float64

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.r_[0, np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            data = [head + flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["node", "root", "copies", "vector"])

    alike = whole.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("root").alias("root"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    distinct = cut(alike.select("node", "root", "copies", "vector").mapInArrow(packed, "node long, root long, copies long, vector binary"))
    found = cut(links(distinct, cosine, trees, seed))
    partners = found.select(F.col("a").alias("node"), F.col("of_b").alias("others")).unionByName(
        found.select(F.col("b").alias("node"), F.col("of_a").alias("others"))
    )
    counted = partners.groupBy("node").agg(F.sum("others").alias("others"))
    joined = components(found.select("a", "b"))

    ids = whole.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    ids = ids.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = ids.groupBy("component").agg(F.min("least").alias("first"))
    ids = ids.join(firsts, "component").join(counted, "node", "left").select(
        "node", "first", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    done = whole.select("id", "node").join(ids, "node", "left").withColumn("first", F.coalesce("first", "id"))
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return done.select(
        real("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real("first").alias("component_id"),
        (F.col("id") == F.col("first")).alias("kept"),
    )


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: links of cosine 0.93 or more between equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.vec_id = e.vec_id LEFT JOIN counted c ON c.vec_id = e.vec_id
"""
