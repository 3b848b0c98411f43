"""Near-duplicate vectors by iterative quantisation and multi-index tables.

A rotation of the principal directions is learned (on a bounded sample) so that
the signs of the rotated vector form a balanced code whose components lie far
from zero. The data are not centred, for cosines are measured from the origin;
bits are balanced as far as the directions are. The code's best bits are dealt
to a few tables.

Two unit vectors of cosine ``c`` are ``e = 2 - 2c`` apart (squared), and a bit
whose signs differ costs at least the squares of both components. So by the
pigeonhole rule some table holds at most ``e / tables`` of that cost, and one of
the two vectors at most half of it. Each vector is stored under its own key in
every table and asks for all keys that it can reach by flipping bits of that
much cost. Thus every pair at or above the threshold meets: recall is 1 by
construction, not by tuning. Pairs that meet are reranked by their cosines in
double precision.

Equal vectors of a label are one class, compared once and counted by its size.
Keys are ``width`` bits wide, about log2 of the classes over ``BLOCK``; few bits
go to two tables, more to four. Keys are dealt without vectors; a bucket of more
than ``BLOCK`` classes is dealt to several blocks, and those who ask for it go
to each. Then each block gets the vectors it compares. A pair that meets more
than once counts where it first could. Only counts and a spanning forest leave a
block, never its pairs. Beyond ``2**MAX_WIDTH * BLOCK`` classes of a label the
blocks of a bucket grow in number and the work faster than the input.

Vectors that are null, zero, of another length or hold null or non-finite
components link with nothing, as do rows with a null label. A cosine equal to
the threshold links. Rows that share an id are vectors of their own. Extra
columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.graph import components
from quernis.llm.scratch import Scratch

BLOCK, SAMPLE, ROUNDS = 4096, 20_000, 30
#: Tables, and how many there are up to which width of their keys.
FEW_TABLES, TABLES, NARROW = 2, 4, 8
MIN_WIDTH, MAX_WIDTH = 4, 16
#: Room for rounding when costs are compared with their limit.
SLACK = 1e-9


def learn_rotation(x: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Orthonormal columns (dimensions by bits): principal directions turned so that signs fit best."""
    d = x.shape[1]
    _, vec = np.linalg.eigh(x.T @ x / max(len(x), 1) + 1e-12 * np.eye(d))
    top = vec[:, ::-1][:, :bits]
    turn, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(bits, bits)))
    v = x @ top
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    return top @ turn


class Index:
    """What a task needs to place vectors: the key bits' directions, table by table."""

    def __init__(self, rotation: np.ndarray, sample: np.ndarray, width: int, threshold: float, tables: int = TABLES):
        size = np.abs(sample @ rotation).mean(axis=0) if len(sample) else np.ones(rotation.shape[1])
        order = np.argsort(-size, kind="stable")
        self.tables = tables
        self.width = min(width, rotation.shape[1] // tables)
        used = order[: self.width * tables].reshape(self.width, tables).T.ravel()
        self.directions = np.ascontiguousarray(rotation[:, used])
        self.threshold = threshold
        self.limit = max(2 - 2 * threshold, 0) / tables / 2 + SLACK

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Key components, summed in one fixed order so that a vector gets the same ones anywhere."""
        out = np.zeros((len(x), self.directions.shape[1]))
        for k in range(x.shape[1]):
            out += x[:, k : k + 1] * self.directions[k]
        return out

    def keys(self, p: np.ndarray) -> np.ndarray:
        """Own keys, rows by tables."""
        return (p.reshape(len(p), self.tables, self.width) > 0) @ (1 << np.arange(self.width))

    def asked(self, p: np.ndarray):
        """Rows, tables and keys within reach by flips of at most ``limit`` cost."""
        cost, own = (p * p).reshape(len(p), self.tables, self.width), self.keys(p)
        for t in range(self.tables):
            row, mask, spent = np.arange(len(p)), np.zeros(len(p), np.int64), np.zeros(len(p))
            for j in range(self.width):
                more = spent + cost[row, t, j]
                ok = more <= self.limit
                row, mask, spent = np.concatenate([row, row[ok]]), np.concatenate([mask, mask[ok] | (1 << j)]), np.concatenate([spent, more[ok]])
            yield t, row, own[row, t] ^ mask

    def first_meeting(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For pairs of rows: 2 * table + (0 if p asks, 1 if q asks) of the first meeting, lesser id as p."""
        flips = (p > 0) != (q > 0)
        out = np.full(len(p), 2 * self.tables)
        for t in range(self.tables - 1, -1, -1):
            for side, v in ((1, q), (0, p)):
                spent = np.zeros(len(v))
                for j in range(t * self.width, (t + 1) * self.width):
                    spent = spent + np.where(flips[:, j], v[:, j] * v[:, j], 0.0)
                out[spent <= self.limit] = 2 * t + side
        return out


def _unit(a: pa.Array, d: int) -> np.ndarray:
    x = a.flatten().to_numpy().astype(np.float64).reshape(-1, d)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _dim(a: pa.Array) -> int:
    return len(a.flatten()) // max(len(a), 1)


def _placed(vectors: DataFrame, index: Index) -> DataFrame:
    """``(label, part, key, asks, row)``: a row for each key at which a vector is stored (``asks`` false) or asked for."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                p = index.turned(_unit(part.column(2), _dim(part.column(2))))
                own = index.keys(p)
                for t, row, key in index.asked(p):
                    rows = np.concatenate([np.arange(part.num_rows), row])
                    take = pa.array(rows)
                    cells = [part.column(1).take(take), pa.array(np.full(len(rows), t, np.int32)), pa.array(np.concatenate([own[:, t], key])), pa.array(np.arange(len(rows)) >= part.num_rows), part.column(0).take(take)]
                    yield pa.RecordBatch.from_arrays(cells, ["label", "part", "key", "asks", "row"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("row", "label", "v").mapInArrow(run, f"label {label}, part int, key bigint, asks boolean, row bigint")


class _Block:
    """Stored vectors of one block, then those who ask for them."""

    def __init__(self, index: Index, table: int):
        self.index, self.table = index, table
        self.ids, self.sizes, self.vectors = [], [], []
        self.ready = False

    def store(self, ids, sizes, x):
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.vectors.append(x)

    def ask(self, ids, sizes, x, counts: dict, forest: list):
        if not self.ids:
            return
        if not self.ready:
            self.id, self.size, self.x = (np.concatenate(c) for c in (self.ids, self.sizes, self.vectors))
            self.p, self.tree, self.ready = self.index.turned(self.x), np.arange(len(self.id)), True
        for k in range(0, len(ids), 512):
            i, j = np.nonzero(x[k : k + 512] @ self.x.T >= self.index.threshold - 1e-6)
            i += k
            # The product only sifts; the decision is one fixed-order sum for each pair.
            keep = (ids[i] != self.id[j])
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 200_000):
                self._pairs(ids, sizes, x, i[a : a + 200_000], j[a : a + 200_000], counts, forest)

    def _pairs(self, ids, sizes, x, i, j, counts, forest):
        if not len(i):
            return
        cosine = np.zeros(len(i))
        for d in range(x.shape[1]):
            cosine += x[i, d] * self.x[j, d]
        ok = cosine >= self.index.threshold
        i, j = i[ok], j[ok]
        if not len(i):
            return
        p = self.index.turned(x)[i]
        q, lesser = self.p[j], ids[i] < self.id[j]
        first = self.index.first_meeting(np.where(lesser[:, None], p, q), np.where(lesser[:, None], q, p))
        mine = first == 2 * self.table + np.where(lesser, 0, 1)
        for who, other in ((ids[i[mine]], self.size[j[mine]]), (self.id[j[mine]], sizes[i[mine]])):
            names, of = np.unique(who, return_inverse=True)
            for v, n in zip(names.tolist(), np.bincount(of, other, len(names)).tolist(), strict=True):
                counts[v] = counts.get(v, 0) + int(n)
        for row in np.unique(i):
            near = j[i == row] if len(i) < 4096 else j[np.searchsorted(i, row) : np.searchsorted(i, row, "right")]
            roots = np.unique(self.tree[near])
            forest += [(int(ids[row]), int(self.id[r])) for r in roots]
            if len(roots) > 1:
                self.tree[np.isin(self.tree, roots)] = roots[0]


def _met(dealt: DataFrame, index: Index) -> DataFrame:
    """``(a, b, n)``: link counts as ``(row, null, n)`` and forest edges as ``(row, row, null)``."""

    def run(batches):
        now, block, counts, forest = None, None, {}, []

        def flush():
            nonlocal counts, forest
            a = [*counts, *[e[0] for e in forest]]
            b = [*[None] * len(counts), *[e[1] for e in forest]]
            n = [*counts.values(), *[None] * len(forest)]
            counts, forest = {}, []
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            bucket, asks, ids, sizes, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "asks", "row", "n", "part"))
            x = _unit(b.column("v"), _dim(b.column("v")))
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *change], [*change, b.num_rows], strict=True):
                if bucket[s] != now:
                    now, block = bucket[s], _Block(index, int(part[s]))
                if asks[s]:
                    block.ask(ids[s:e], sizes[s:e], x[s:e], counts, forest)
                else:
                    block.store(ids[s:e], sizes[s:e], x[s:e])
            if len(counts) + len(forest) > 100_000:
                yield flush()
        yield flush()

    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: a row for each vector.

    ``sample`` bounds the rows the rotation is learned on; it does not affect
    which pairs are found. ``threshold`` is a cosine above 0.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "itq")
    # Single-precision components travel as they are; all sums are in double precision.
    v = F.col(vector) if rows.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    of = F.md5(F.concat_ws(",", F.transform("v", lambda c: c.cast("string"))))
    every = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.when(fine & F.col(label).isNotNull(), v).alias("v"), F.monotonically_increasing_id().alias("row"))
    every = scratch.put("vectors", every.withColumn("of", F.when(F.col("v").isNotNull(), of)))
    classes = scratch.put("classes", every.where("v is not null").groupBy("label", "of").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")))
    found = scratch.put("found", every.select("row", "label", "v").join(classes.select("row", "n"), "row"))
    # Vectors are compared with those of their own length; lengths other than the usual one are indexed apart.
    sizes = [r[0] for r in found.groupBy(F.size("v").alias("d")).count().select("d").orderBy("d").collect()]
    links = counts = None
    for d in sizes:
        mine = found.where(F.size("v") == d)
        n = mine.count()
        width = min(max(math.ceil(math.log2(max(n, 1) / BLOCK)) if n > BLOCK else 0, MIN_WIDTH), MAX_WIDTH)
        chosen = mine.orderBy(F.xxhash64("row")).limit(sample).select("v").toArrow().column(0).combine_chunks()
        x = _unit(chosen, d)
        bits = min(d, 64)
        tables = FEW_TABLES if width <= NARROW or bits < 4 * TABLES else TABLES
        if bits < tables:
            index = Index(np.eye(d, tables), x, 1, threshold, tables)
        else:
            index = Index(learn_rotation(x, bits), x, width, threshold, tables)
        placed = scratch.put("placed", _placed(mine, index))
        dealt = _dealt(scratch, placed).join(mine.select("row", "n", "v"), "row").repartition("bucket").sortWithinPartitions("bucket", "asks", "row").select("bucket", "asks", "row", "n", "v", "part")
        met = scratch.put("met", _met(dealt, index))
        scratch.drop(placed)
        c = met.where("b is null").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
        e = met.where("b is not null").select("a", "b")
        counts, links = (c, e) if counts is None else (counts.union(c), links.union(e))
    if counts is None:
        return every.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(scratch, links).withColumnRenamed("node", "class")
    members = every.select("row", "vec_id", "label", "of").join(classes.select("label", "of", F.col("row").alias("class"), "n"), ["label", "of"], "left").select("row", "vec_id", "class", "n")
    named = scratch.put("members", members.join(labels, "class", "left").withColumn("group", F.coalesce("label", "class")))
    least = named.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "group", "left").join(counts.withColumnRenamed("row", "class"), "class", "left")
    component = F.coalesce("least", "vec_id")
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _dealt(scratch: Scratch, placed: DataFrame) -> DataFrame:
    """``(bucket, part, asks, row)``: whoever asks goes to each block of the bucket, the stored ones to one each."""
    here = ["label", "part", "key"]
    crowded = placed.where("not asks").groupBy(*here).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    # Few buckets are crowded, so this table is small beside the rows, and Catalyst sees its size.
    crowded = scratch.put("crowded", crowded)
    rows = placed.join(crowded, here, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    return rows.select(F.xxhash64(*here, "block").alias("bucket"), "part", "asks", "row")
