"""Near-duplicate documents by MinHash signatures in a multi-index Hamming join.

A signature is ``CHUNKS * WIDTH`` symbols of ``b`` bits, each the low bits of
one minimum of the document's shingle hashes, so two documents differ in a
symbol with probability ``(1 - J)(1 - 2**-b)``. The signature is cut into
``CHUNKS`` chunks and one wrong symbol is allowed in a chunk: by the pigeonhole
rule every pair that differs in at most ``2 * CHUNKS - 1`` symbols has a chunk
with at most one wrong symbol, and masking each symbol in turn makes such
chunks equal. Pairs that share a masked chunk and differ in at most
``MAX_DISTANCE`` symbols are confirmed on their full shingle sets.

At a similarity of 0.8 a chunk fits with probability 0.66, so a pair is missed
with probability 0.345**10 = 2.4e-5, and less above. Confirmed links are exact.

Nulls and odd rows: a null or empty text has no shingles and links with
nothing; a text of fewer words than a shingle is one shingle; rows with a null
id get a null component and are kept. Rows that share an id are judged each by
its own text. Ties do not arise: the least id names a component. Identical sets
form one class before the join, so exact copies never meet in pairs. Texts may
have any length; one document's set stands in memory at a time, a block of them
by bytes. Extra columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernis.llm.bits import KeyFilter
from quernis.llm.near_index import Rules, linked_components, sharing
from quernis.llm.scratch import Scratch
from quernis.llm.text import U64, mix, release, shingles, slices, word_hashes

CHUNKS, WIDTH, BITS = 10, 6, 8
#: Pairs beyond this many different symbols of the 60 are not confirmed: at a similarity of 0.8 one in a million.
MAX_DISTANCE = 30
#: Likely pairs of a set in a crowd that are listed: no more rows than members, for sets are large and meet in tiles.
EACH = 1


@dataclass(frozen=True)
class Shingling:
    words: int = 5
    #: Links need ``100 * intersection >= percent * union``.
    percent: int = 80


_r = np.random.Generator(np.random.PCG64(77))
_FLIP = _r.integers(0, 2**64, CHUNKS * WIDTH, dtype=U64)[:, None]
_TIMES = (_r.integers(0, 2**64, CHUNKS * WIDTH, dtype=U64) | U64(1))[:, None]
#: A signature's bytes: the symbols, then the number of shingles.
SIG = CHUNKS * WIDTH + 4


def signature(sh: np.ndarray) -> bytes:
    """A byte for each symbol, chunk by chunk, and the size of the set."""
    least = np.full(CHUNKS * WIDTH, 2**64 - 1, U64)
    for k in range(0, len(sh), 2048):
        np.minimum(least, ((sh[None, k : k + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return (mix(least) & U64((1 << BITS) - 1)).astype(np.uint8).tobytes() + np.array([len(sh)], "<u4").tobytes()


def set_of(words: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The shingle set and a 64-bit name for it."""
    sh = shingles(words, size)
    return sh, xxhash.xxh3_64_intdigest(sh.tobytes()) - 2**63


def signed(df: DataFrame, text: str, doc_id: str, how: Shingling) -> DataFrame:
    """``(doc_id, of, n_shingles, node, sig)``: a row for each document; ``of`` is its text's hash, ``node`` names its set."""

    def run(batches):
        for b in slices(batches, 1):
            h, at = word_hashes(b.column(1))
            n = b.num_rows
            count, node, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for k in range(n):
                if at[k + 1] > at[k]:
                    sh, node[k] = set_of(h[at[k] : at[k + 1]], how.words)
                    count[k], sig[k] = len(sh), signature(sh)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count), pa.array(node), pa.array(sig, pa.binary())], ["doc_id", "of", "n_shingles", "node", "sig"])
        release()

    texts = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), texts.alias("text"), F.xxhash64(texts).alias("of")).mapInArrow(run, "doc_id bigint, of bigint, n_shingles bigint, node bigint, sig binary")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), SIG)


def masked_keys(sigs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk with each of its symbols masked, above them which chunk and symbol; and how many keys each row has."""
    x = _matrix(sigs)
    out = np.zeros((len(x), CHUNKS, WIDTH), np.int64)
    wide = np.zeros((len(x), CHUNKS, 8), np.uint8)
    wide[:, :, :WIDTH] = x[:, : CHUNKS * WIDTH].reshape(-1, CHUNKS, WIDTH)
    whole = wide.view("<i8")[:, :, 0]
    for i in range(CHUNKS):
        for j in range(WIDTH):
            out[:, i, j] = (whole[:, i] & ~(0xFF << (8 * j))) | ((i * WIDTH + j) << 48)
    return out.ravel(), np.full(len(x), CHUNKS * WIDTH)


def likely(key: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose first common key this is, that are near enough and whose sizes allow a link."""
    chunk, symbol = divmod(key >> 48, WIDTH)
    wrong = np.zeros((CHUNKS, len(x), len(y)), np.uint8)
    for i in range(CHUNKS):
        for j in range(WIDTH):
            wrong[i] += x[:, None, i * WIDTH + j] != y[None, :, i * WIDTH + j]
    at = chunk * WIDTH + symbol
    here = (wrong[chunk] == 0) if symbol == 0 else np.zeros(wrong.shape[1:], bool)
    here |= (wrong[chunk] == 1) & (x[:, None, at] != y[None, :, at])
    n, m = (np.ascontiguousarray(v[:, CHUNKS * WIDTH :]).view("<u4")[:, 0].astype(np.int64) for v in (x, y))
    small, large = np.minimum(n[:, None], m[None]), np.maximum(n[:, None], m[None])
    return here & (wrong[:chunk] > 1).all(axis=0) & (wrong.sum(axis=0) <= MAX_DISTANCE) & (100 * small >= percent * large)


def _sets(docs: DataFrame, text: str, doc_id: str, how: Shingling, wanted: DataFrame) -> DataFrame:
    """``(node, sh)`` for the classes ``wanted(node, rep)``, recomputed from one document each.

    Only sets of the wanted ids leave the tasks: texts are not shuffled.
    """
    pick = KeyFilter(wanted.select(F.xxhash64("rep").alias("k")), "k", wanted.count())
    rows = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.xxhash64(F.col(doc_id).cast("bigint")).alias("k"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for part in slices((b.filter(pa.array(pick.may_hold(b.column(1).to_numpy()))) for b in batches), 2):
            h, at = word_hashes(part.column(2))
            sets = [set_of(h[at[i] : at[i + 1]], how.words) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in sets], pa.int64()), pa.array([s.tobytes() for s, _ in sets], pa.binary())], ["rep", "node", "sh"])
        release()

    # An id may stand on several rows: one set of each class is kept.
    out = rows.mapInArrow(run, "rep bigint, node bigint, sh binary")
    # The id is compared, not joined on, so that the sets are shuffled once, by class.
    exact = out.join(wanted.withColumnRenamed("rep", "of"), "node").where((F.col("rep") <= F.col("of")) & (F.col("rep") >= F.col("of")))
    return exact.groupBy("node").agg(F.first("sh").alias("sh"))


def _of(sets: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The sets that an exact join with ``nodes(node)``, some ``n``, will want, and few others."""
    pick = KeyFilter(nodes, "node", n)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(pick.may_hold(b.column(0).to_numpy())))

    return sets.mapInArrow(run, "node bigint, sh binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are near enough."""
    some = _of(sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), 2 * pairs.count())
    full = pairs.join(some.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a").join(some.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                small, large = min(len(p), len(q)), max(len(p), len(q))
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[k] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _links(x: list, y: list, percent: int):
    """Links that connect whatever is linked between sets of ``x`` and of ``y``: ``y`` is an inverted list, ``x`` counts in it."""
    ids, tree = (np.array(c) for c in zip(*[r[:2] for r in y], strict=True))
    sets = [np.frombuffer(p, U64) for *_, p in y]
    size = np.array([len(s) for s in sets])
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, of, now = every[order], of[order], {}
    for node, label, payload in x:
        sh = np.frombuffer(payload, U64)
        lo, hi = np.searchsorted(every, sh, "left"), np.searchsorted(every, sh, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(of[at], minlength=len(ids))
        mine = now.get(label, label)
        linked = np.flatnonzero((100 * both >= percent * (len(sh) + size - both)) & (both > 0) & (ids != node) & (tree != mine))
        for root, first in zip(*np.unique(tree[linked], return_index=True), strict=True):
            yield node, int(ids[linked[first]])
            tree[tree == root] = mine
            now = {k: mine if v == root else v for k, v in now.items()} | {int(root): mine}


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Shingling = Shingling()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, of)``: a row for each document.

    ``component_id`` is the least id that links lead to; a document is kept if
    that is its own. ``of`` is ``xxhash64`` of its text.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    all_docs = scratch.put("signed", signed(docs, text, doc_id, how))
    classes = scratch.put("classes", all_docs.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), (F.first("n_shingles") * 8).alias("bytes")))
    pairs, crowd = sharing(scratch, classes.select("node", "sig", (F.col("bytes") / 8).cast("bigint").alias("size")), masked_keys, classes.count() * CHUNKS * WIDTH, how.percent)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()
    wanted = scratch.put("wanted", nodes.join(classes.select("node", "rep"), "node"))
    sets = scratch.put("sets", _sets(docs, text, doc_id, how, wanted))
    rules = Rules(
        verify=lambda pairs: _confirmed(pairs, sets, how.percent),
        likely=lambda key, x, y: likely(key, x, y, how.percent),
        payload=lambda _: sets.withColumnRenamed("sh", "payload"),
        tile=lambda x, y: _links(x, y, how.percent),
        each=EACH,
    )
    labels = linked_components(scratch, pairs, crowd, classes.select("node", "sig", "bytes"), rules)
    named = classes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    component = scratch.put("components", named.join(least, "label").select("node", F.col("least").alias("class_least")))
    out = all_docs.join(component, (all_docs.node == component.node) & (all_docs.n_shingles > 0) & all_docs.doc_id.isNotNull(), "left")
    component_id = F.coalesce("class_least", all_docs.doc_id)
    return out.select(all_docs.doc_id, all_docs.n_shingles, component_id.alias("component_id"), F.coalesce(component_id == all_docs.doc_id, F.lit(True)).alias("kept"), all_docs.of)


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Shingling = Shingling()) -> DataFrame:
    """The documents that are kept, same columns. A row goes by its id and its text, so another text of that id stays."""
    scratch = Scratch(docs.sparkSession, "copies")
    gone = scratch.put("gone", near_duplicates(docs, text, doc_id, how).where("not kept").select("doc_id", "of").distinct())
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, own_text = (F.col(f"c{docs.columns.index(c)}") for c in (doc_id, text))
    same = (own.cast("bigint") == gone.doc_id) & (F.xxhash64(own_text.cast("string")) == gone.of)
    return rows.join(gone, same, "left_anti").toDF(*docs.columns)
