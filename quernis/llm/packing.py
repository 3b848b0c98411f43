"""Packing documents into fixed-length sequences along a space-filling curve.

A document's words are hashed, projected to a few dimensions and placed on a
grid; the Hilbert key of its cell puts like documents near each other. Rows are
range-partitioned by that key, sorted, tokenised and laid one after the other
into sequences. Only a partition's last tokens may leave a sequence short; they
are split into lengths that are powers of two, which need no padding.

Equal keys are dealt by a hash of the id, so many copies of one text spread
over partitions. A null text counts as empty: its one token is the end id. A
text may have any length: it is cut freely, and its ids stand in memory at once.
Null ids and repeated rows are packed like others, extra columns are passed by,
and an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.text import U64, release, slices, word_hashes
from quernis.llm.tokens import Encoder

DIMS, BITS, SLOTS = 4, 8, 1 << 16
#: Rows sampled for each range partition, and bytes of text in one.
SAMPLE, PART_BYTES = 200, 16 << 20
_PROJECT = np.random.Generator(np.random.PCG64(9)).normal(0, 1 << 12, (SLOTS, DIMS)).astype(np.int64)


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``grid``, whose numbers are below ``2**bits``."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the coarser levels
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def places(texts: pa.Array) -> np.ndarray:
    """Grid cells: the mean of the words' projections, squeezed into the grid."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    total = np.zeros((len(n), DIMS), np.int64)
    full = np.flatnonzero(n)
    slots = (h >> U64(48)).astype(np.int64)
    for d in range(DIMS):
        if len(full):
            total[full, d] = np.add.reduceat(_PROJECT[slots, d], at[:-1][full])
    mean = total / np.maximum(n, 1)[:, None] / (1 << 12)
    return np.clip((np.tanh(3 * mean) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _placed(docs: DataFrame, text: str, doc_id: str, bounds: np.ndarray | None) -> DataFrame:
    """``(doc_id, text, place, part)``: the Hilbert key above a hash of the id, and the range it falls into."""

    def run(batches):
        for b in slices(batches, 1):
            place = (hilbert_keys(places(b.column(1)), BITS) << 31) | (b.column(2).to_numpy() & (2**31 - 1))
            part = np.zeros(len(place), np.int32) if bounds is None else np.searchsorted(bounds, place, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(place), pa.array(part)], ["doc_id", "text", "place", "part"])
        release()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("bigint")).alias("tie"))
    return rows.mapInArrow(run, "doc_id bigint, text string, place bigint, part int")


def along_curve(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """``(doc_id, text)`` sorted along the curve within range partitions of some ``PART_BYTES`` of text.

    The ranges' bounds are quantiles, by bytes of text, of a sample of some
    ``SAMPLE`` rows for each partition. They only balance the partitions; every row is placed.
    """
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text).cast("string")).cast("bigint"))).first()
    parts = parts or max(1, -(-(size or 0) // PART_BYTES))
    some = docs.sample(min(1.0, SAMPLE * parts / max(rows, 1)), seed=17)
    seen = _placed(some, text, doc_id, None).select("place", F.octet_length("text").alias("n")).toArrow().sort_by("place")
    place, room = seen.column("place").to_numpy(), np.cumsum(seen.column("n").fill_null(0).to_numpy() + 1)
    bounds = place[np.searchsorted(room, np.arange(1, parts) * room[-1] // parts)] if len(place) else place
    placed = _placed(docs, text, doc_id, bounds)
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "doc_id").select("doc_id", "text")


class _Packer:
    """Pieces of sequences; the open sequence is held back until it is full or the rows end."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.fill = length, first, 0
        self.open: list[tuple] = []

    def add(self, doc_id, ids: bytes):
        tokens, start = len(ids) // 4, 0
        while start < tokens:
            n = min(tokens - start, self.length - self.fill)
            self.open.append((doc_id, start, n, tokens, ids[4 * start : 4 * (start + n)]))
            start += n
            self.fill += n
            if self.fill == self.length:
                yield from self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces):
        at = 0
        for doc_id, start, n, tokens, ids in pieces:
            yield doc_id, start, n, tokens, self.sequence, at, ids
            at += n
        self.sequence += 1

    def end(self):
        """What is left, in sequences whose lengths are falling powers of two."""
        rest, self.open = self.open, []
        while rest:
            room = 1 << (sum(p[2] for p in rest).bit_length() - 1)
            now, later = [], []
            for doc_id, start, n, tokens, ids in rest:
                take = min(n, room)
                room -= take
                if take:
                    now.append((doc_id, start, take, tokens, ids[: 4 * take]))
                if take < n:
                    later.append((doc_id, start + take, n - take, tokens, ids[4 * take :]))
            yield from self._close(now)
            rest = later


PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each piece with its ids (little-endian unsigned 32-bit): see ``PIECES``.

    ``tokenizer`` is the path of a tokenizer file that every executor sees.
    Sequence ids are unique: partition number in the high bits, then a count.
    """
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = Encoder.of(tokenizer)
        packer = _Packer(length, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []
        size = 0
        for b in batches:
            names = b.column(0).to_pylist()
            for k, name in enumerate(names):
                for piece in packer.add(name, enc.ids(b.column(1)[k].as_py()).tobytes() + closing):
                    out.append(piece)
                    size += len(piece[-1])
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        out += packer.end()
        if out:
            yield _batch(out)
        del out
        release()

    return along_curve(docs, text, doc_id).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
