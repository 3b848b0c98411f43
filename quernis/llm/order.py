"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride shards.

Documents become sequences of ``length`` token ids, the last one padded. A first
pass counts each input partition's sequences, which numbers them all densely. A
keyed Feistel network on the next even power of two, walked until it falls below
the number of sequences, gives each its global slot. Slots are range-partitioned
into shards of ``per_shard`` records of one stride, the last one shorter, so any
slot is one seek away and a training run resumes from a slot number alone.

Token ids are moved once, to their shard; texts are tokenised in both passes,
which costs less than keeping ids in between. Both passes must see the same
partitions: an input that is more than a scan of files is written to files
first. Shards are written beside their place and moved there whole. Null and
empty texts give no sequence; a text may have any length, its ids stand in
memory at once. Rows with equal or null ids are told apart by their slots. Extra
columns are passed by; an empty table gives no shard.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.scratch import Scratch
from quernis.llm.tokens import Encoder

ROUNDS = 4


def _scramble(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + turn * 0xD1B54A32D192ED03) % 2**64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of ``0..n-1`` chosen by ``key``, at the given positions."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_scramble(right, key, turn) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", folder)))


def _only_scanned(df: DataFrame) -> bool:
    """Whether the rows come straight from files, so that each reading deals them alike."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    names = re.findall(r"^[\s:+*\-()0-9]*([A-Za-z]+)", plan, re.M)
    return bool(names) and all(n in ("FileScan", "Project", "Filter", "ColumnarToRow") for n in names)


def materialise(docs: DataFrame, folder: str, tokenizer: str, length: int = 256, per_shard: int = 65_536, key: int = 1, pad_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes ``shard-NNNNN.bin`` files and ``order.json``; returns ``(doc_id, start, n_tokens, slot, shard, position, ids_crc32)``.

    ``position`` is the record's byte offset in its shard. Ids are unsigned
    16-bit little-endian numbers there, 32-bit ones if the vocabulary is larger;
    the checksum is over the unpadded ones.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "order")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if not _only_scanned(rows):
        rows = scratch.put("rows", rows)
    kind = "<u4" if Encoder.of(tokenizer).size > 1 << 16 else "<u2"
    stride = np.dtype(kind).itemsize * length

    def count(batches):
        enc, n = Encoder.of(tokenizer), 0
        for b in batches:
            n += sum(-(-len(enc.ids(t.as_py())) // length) for t in b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], ["part", "n"])

    first, total = {}, 0
    for part, n in sorted(map(tuple, rows.mapInArrow(count, "part bigint, n bigint").collect())):
        first[part] = (total, n)
        total += n
    shards = max(1, -(-total // per_shard))

    def deal(batches):
        enc = Encoder.of(tokenizer)
        begin, n = first.get(TaskContext.get().partitionId(), (0, 0))
        at = begin
        out: list[list] = [[], [], [], []]

        def flush():
            slot = slots(np.arange(at - len(out[0]), at), total, key)
            cells = [*[pa.array(c, pa.int64()) for c in out[:3]], pa.array(slot), pa.array(slot // per_shard, pa.int32()), pa.array(out[3], pa.binary())]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", "slot", "shard", "ids"])

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens = enc.ids(t.as_py()).astype(kind)
                for s in range(0, len(tokens), length):
                    part = tokens[s : s + length]
                    for c, v in zip(out, (name, s, len(part), part.tobytes()), strict=True):
                        c.append(v)
                    at += 1
                    if at - begin > n:
                        raise RuntimeError("the input's files changed while they were read")
                if len(out[0]) >= 4096:
                    yield flush()
        if at - begin != n:
            raise RuntimeError("the input's files changed while they were read")
        if out[0]:
            yield flush()

    fields = "doc_id bigint, start bigint, n_tokens bigint, slot bigint, shard int, ids binary"
    dealt = rows.mapInArrow(deal, fields).repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    padding = np.full(length, pad_id, kind).tobytes()
    store, top = _store(folder)
    store.create_dir(top, recursive=True)

    def write(batches):
        here, at = _store(folder)
        name = made = out = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                shard = b.column(4)[0].as_py()
                name, made = f"{at}/shard-{shard:05d}.bin", f"{at}/.shard-{shard:05d}.{uuid.uuid4().hex}"
                out = here.open_output_stream(made)
            cells = b.column(5).to_pylist()
            out.write(b"".join(v + padding[len(v) :] for v in cells))
            proofs = pa.array([zlib.crc32(v) for v in cells], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(b.column(3).to_numpy() % per_shard * stride), proofs], ["doc_id", "start", "n_tokens", "slot", "shard", "position", "ids_crc32"])
        if out:
            out.close()
            here.move(made, name)

    # The ids stay in the shards; the table holds where they are and a proof of them.
    written = scratch.put("written", dealt.mapInArrow(write, "doc_id bigint, start bigint, n_tokens bigint, slot bigint, shard int, position bigint, ids_crc32 bigint"))
    with store.open_output_stream(f"{top}/order.json") as f:
        f.write(json.dumps({"length": length, "stride": stride, "kind": kind, "key": key, "pad_id": pad_id, "sequences": total, "per_shard": per_shard}).encode())
    return written


def read_slots(folder: str, begin: int, n: int) -> np.ndarray:
    """``n`` records from slot ``begin`` on, as a matrix of ids: sequential reads, one open file at a time."""
    store, top = _store(folder)
    with store.open_input_stream(f"{top}/order.json") as f:
        o = json.loads(f.read())
    out, end = [], min(begin + n, o["sequences"])
    while begin < end:
        shard, at = divmod(begin, o["per_shard"])
        take = min(o["per_shard"] - at, end - begin)
        with store.open_input_file(f"{top}/shard-{shard:05d}.bin") as f:
            f.seek(at * o["stride"])
            out.append(np.frombuffer(f.read(take * o["stride"]), o["kind"]).reshape(take, o["length"]))
        begin += take
    return np.concatenate(out) if out else np.zeros((0, o["length"]), o["kind"])
