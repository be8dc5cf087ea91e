"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are at squared distance <= 2 - 2c. A fixed rotation spreads a vector's energy evenly; the rotated
vector is split into blocks of BLOCK dimensions and the squared distance into budgets proportional to the blocks' dimensions:
a pair within the whole distance is within budget in one block at least. Each block is a range join in few dimensions: a kd-tree
of cells (medians of a bounded sample; they only set the cells' sizes) gives each vector one home cell, and the vector visits
every other cell whose box is within the block's radius. A pair counts in its first block within budget, in the cell that is home
to its one side, and is then verified by the cosine in double precision. Rotated coordinates are rounded to integers (budgets are
widened by the rounding), so that squared block distances are exact and both sides agree on the first block.

Scale: equal vectors are one class first. Home vectors of a cell are split into chunks of at most CELL (hot cells too); a task
holds one chunk, in a tree of its own, and streams its visitors past it, one batch at a time, so memory is bounded whatever a cluster's size. Counts of
links come out per vector, and for components one edge per visitor and chunk, never the pairs. Work on a cluster of mutual near
copies is quadratic by definition of n_links, as batched matrix products.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
length never link; every row is a vector of its own, also where a vec_id repeats with another vector: classes are numbered, ids are
labels carried along. Repeated rows link with each other; a row with null vec_id links and bridges like others, its component_id is
the least id reachable, null if there is none; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm.components import components
from wardline.llm.shared import cut, partitions, table

COSINE = 0.9
BLOCK, CELL, SAMPLE = 8, 32_768, 20_000
UNIT = float(1 << 20)
VISITORS, LEAF, PAIRS = 1024, 512, 50_000
Batches = Iterator[pa.RecordBatch]
Node = tuple[int, float] | None


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(20_011).standard_normal((dims, dims)))[0]


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def radii(dims: int, cosine: float) -> np.ndarray:
    """Block radii in rounded units, widened by what rounding can add."""
    return np.array([math.sqrt((2 - 2 * cosine + 1e-9) * (b.stop - b.start) / dims) * UNIT + math.sqrt(b.stop - b.start) + 1 for b in blocks(dims)])


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, without overflow for large components."""
    x = vectors.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rounded(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.rint(unit @ turn * UNIT)


def grow(points: np.ndarray, depth: int) -> list[Node]:
    """A kd-tree over one block as a heap: (dimension, split) per inner node, the dimension of widest spread first."""
    tree: list[Node] = [None] * (2 << depth)

    def split(at: int, part: np.ndarray, left: int) -> None:
        if left:
            dim = int(np.argmax(part.std(axis=0))) if len(part) else 0
            value = float(np.floor(np.median(part[:, dim]))) if len(part) else 0.0
            tree[at] = (dim, value)
            low = part[:, dim] <= value
            split(2 * at, part[low], left - 1)
            split(2 * at + 1, part[~low], left - 1)

    split(1, points, depth)
    return tree


def cells(points: np.ndarray, tree: list[Node], radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cell, is home) for every cell whose box is within the radius of the point."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(at: int, who: np.ndarray, home: np.ndarray, gap: np.ndarray) -> None:
        if not len(who):
            return
        if tree[at] is None:
            out.append((who, at, home))
            return
        dim, value = tree[at]
        x = points[who, dim]
        for child, inside, off in ((2 * at, x <= value, x - value), (2 * at + 1, x > value, value - x)):
            # points beyond the split: the box is at least `off` away along this dimension
            near = gap.copy()
            near[:, dim] = np.where(inside, gap[:, dim], np.maximum(gap[:, dim], off))
            keep = (near * near).sum(axis=1) <= radius * radius
            go(child, who[keep], (home & inside)[keep], near[keep])

    n = len(points)
    go(1, np.arange(n), np.ones(n, bool), np.zeros_like(points))
    return tuple(np.concatenate(c) for c in zip(*((w, np.full(len(w), c), h) for w, c, h in out), strict=True)) if out else (np.zeros(0, int),) * 3


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _deal(trees: list[list[Node]], dims: int, cosine: float) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        turn, radius, parts = rotation(dims), radii(dims, cosine), blocks(dims)
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                q = rounded(units(_matrix(batch.column(2))), turn)
                for b, (part, tree) in enumerate(zip(parts, trees, strict=True)):
                    who, cell, home = cells(q[:, part], tree, radius[b])
                    rows = batch.take(pa.array(who))
                    own = [pa.array(np.full(len(who), b, np.int32)), pa.array(cell.astype(np.int64)), pa.array(home.astype(bool))]
                    yield pa.RecordBatch.from_arrays([*own, *rows.columns], names=["block", "cell", "home", "id", "copies", "v"])

    return run


class Chunk:
    """Home vectors of one chunk of a cell: link counts, the link forest, and what streams past."""

    def __init__(self, key: tuple, dims: int, cosine: float) -> None:
        self.key, self.cosine, self.parts, self.radius, self.turn = key, cosine, blocks(dims), radii(dims, cosine), rotation(dims)
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def close_homes(self) -> list[tuple[int, int]]:
        """Once all homes are in: the chunk's own tree, and the homes' links among themselves."""
        if self.ready:
            return []
        self.ids, self.copies, v = (np.concatenate(c) for c in zip(*self.rows, strict=True)) if self.rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.turn.shape[0])))
        self.rows, self.ready = [], True
        self.unit = units(v) if len(v) else v.astype(float)
        self.q = rounded(self.unit, self.turn)
        own = self.q[:, self.parts[self.key[0]]]
        self.tree = grow(own, max(0, math.ceil(math.log2(max(1, len(own) / LEAF)))))
        who, leaf, _ = cells(own, self.tree, 0.0)
        self.leaves = {int(x): who[leaf == x] for x in np.unique(leaf)}
        self.rough = {x: self._extended(self.q[w], -2.0, flip=True) for x, w in self.leaves.items()}
        self.links, self.label = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        edges = []
        for k in range(0, len(self.ids), VISITORS):
            here = slice(k, k + VISITORS)
            edges += self._pass(self.ids[here], self.copies[here], self.unit[here], self.q[here])
        return edges

    def _extended(self, q: np.ndarray, factor: float, flip: bool) -> np.ndarray:
        """Rows whose products are squared block distances, in single precision: for a first, wider test."""
        x = (q[:, self.parts[self.key[0]]] / UNIT).astype(np.float32)
        square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)
        return np.hstack([x * np.float32(factor), one, square] if flip else [x, square, one])

    def past(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> list[tuple[int, int]]:
        """Lets visitors pass; gives an edge for each that links."""
        unit = units(vectors)
        return self.close_homes() + self._pass(ids, copies, unit, rounded(unit, self.turn))

    def _pass(self, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        block, edges = self.key[0], []
        wide = np.float32((self.radius[block] / UNIT) ** 2 * 1.001)
        rough = self._extended(q, 1.0, flip=False)
        who, leaf, _ = cells(q[:, self.parts[block]], self.tree, self.radius[block])
        for x, homes in self.leaves.items():
            some = who[leaf == x]
            if len(some):
                i, j = np.nonzero(rough[some] @ self.rough[x].T <= wide)
                for a in range(0, len(i), PAIRS):
                    edges += self._meet(some[i[a : a + PAIRS]], homes[j[a : a + PAIRS]], ids, copies, unit, q)
        return edges

    def _meet(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of visitor and home: exact block distances, earlier blocks, cosine. Sums have one order, so both sides agree."""
        block = self.key[0]
        keep = ids[i] != self.ids[j]
        for b in [block, *range(block)]:
            i, j = i[keep], j[keep]
            gap = q[i, self.parts[b]] - self.q[j, self.parts[b]]
            keep = ((gap * gap).sum(axis=1) <= self.radius[b] ** 2) == (b == block)
        i, j = i[keep], j[keep]
        keep = np.einsum("ij,ij->i", unit[i], self.unit[j]) >= self.cosine
        i, j = i[keep], j[keep]
        if not len(i):
            return []
        self.links += np.bincount(j, copies[i], minlength=len(self.ids)).astype(np.int64)
        edges, order = [], np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for a, b in zip(*(lambda s: (s, [*s[1:], len(i)]))(np.flatnonzero(np.append(True, i[1:] != i[:-1])).tolist()), strict=True):
            labels = np.unique(self.label[j[a:b]])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]
            edges.append((int(ids[i[a]]), int(self.ids[labels[0]])))
        return edges

    def result(self) -> list[tuple[int, int, int]]:
        rest = [(1, a, b) for a, b in self.close_homes()]
        counts = [(0, int(i), int(n)) for i, n in zip(self.ids, self.links, strict=True) if n]
        return rest + counts + [(1, int(i), int(self.ids[k])) for i, k in zip(self.ids, self.label, strict=True) if self.ids[k] != i]


def _probe(dims: int, cosine: float) -> Callable[[Batches], Batches]:
    """Over rows sorted by (block, cell, chunk), homes first."""

    def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["kind", "a", "b"])

    def run(batches: Batches) -> Batches:
        now: Chunk | None = None
        for batch in batches:
            key = [batch.column(k).to_numpy() for k in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1 if batch.num_rows else np.zeros(0, int)
            home, ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                at = tuple(int(k[a]) for k in key)
                if now is None or now.key != at:
                    if now:
                        yield out(now.result())
                    now = Chunk(at, dims, cosine)
                v = _matrix(batch.column(6).slice(a, b - a))
                h = home[a:b].astype(bool)
                if h.any():
                    now.rows.append((ids[a:b][h], copies[a:b][h], v[h]))
                rest = np.flatnonzero(~h)
                for k in range(0, len(rest), VISITORS):
                    some = rest[k : k + VISITORS]
                    if edges := now.past(ids[a:b][some], copies[a:b][some], v[some]):
                        yield out([(1, x, y) for x, y in edges])
        if now:
            yield out(now.result())

    return run


def _links(vectors: DataFrame, dims: int, rows: int, cosine: float) -> DataFrame:
    """(kind, a, b): kind 0 has a's number of linked vectors in b, kind 1 is an edge; for vectors (id, copies, v) of one length."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toPandas()["v"]
    q = rounded(units(np.array(sample.tolist())), rotation(dims))
    depth = max(0, math.ceil(math.log2(max(1, rows / CELL))))
    trees = [grow(q[:, b], depth) for b in blocks(dims)]
    kind = vectors.schema["v"].dataType.simpleString()
    dealt = vectors.select("id", "copies", "v").mapInArrow(_deal(trees, dims, cosine), f"block int, cell long, home boolean, id long, copies long, v {kind}")
    dealt = cut(dealt, "embedding-cells")
    split = dealt.where("home").groupBy("block", "cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    # a home vector also visits the other chunks of its cell
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.struct(c.alias("chunk"), (F.col("home") & (c == own)).alias("home")))
    each = dealt.join(split, ["block", "cell"]).select("block", "cell", "id", "copies", "v", F.explode(place).alias("p")).select("block", "cell", F.col("p.chunk").alias("chunk"), F.col("p.home").alias("home"), "id", "copies", "v")
    each = each.repartition(partitions(spark), "block", "cell", "chunk").sortWithinPartitions("block", "cell", "chunk", F.col("home").desc())
    return each.mapInArrow(_probe(dims, cosine), "kind long, a long, b long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) to (vec_id, n_links, component_id, kept)."""
    fine = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("embedding")).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # written, so that the numbers hold
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "embedding-classes")
    links = None
    for dims, n in classes.groupBy(F.size("v")).count().collect():
        some = _links(classes.where(F.size("v") == dims), dims, n, cosine)
        links = some if links is None else links.union(some)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = cut(links, "embedding-links")
    counts = links.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    comps = components(links.where("kind = 1").select("a", "b"), "embedding")
    known = classes.join(counts, "id", "left").join(comps, "id", "left")
    known = cut(known.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("group")), "embedding-known")
    known = known.join(known.groupBy("group").agg(F.min("least").alias("component")), "group").drop("group", "least")
    out = rows.join(known, "v", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.y, r.seen FROM r JOIN l ON l.x = r.id AND r.seen < l.y),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) c ON c.id = v.vec_id
"""
