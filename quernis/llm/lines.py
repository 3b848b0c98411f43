"""Fuzzy line deduplication: of each connected group of like lines one occurrence stays.

Lines are normalised (lower case; each run of ASCII signs and white space is one
blank, none at the ends) and equal ones form a class. Two classes are linked if
their edit similarity, ``1 - edits / length of the longer``, is ``similarity``
or more.

Candidates come from SimHash blocks. A plain SimHash spreads each changed word
over all its bits, so hashes of lines that differ in one word of six are far
apart. Here each block of the hash is the majority of bits over only those words
that fall to it, so a changed word upsets the blocks it leaves and enters and no
other: with ``d`` words replaced at least ``blocks - 2 d`` blocks stay equal.
Lines that agree in one block, in the same place of as many blocks, are
candidates. A block of few letters goes together with the next, so that frequent
words alone make no key, and a word counts once in a block. The number of blocks grows with the line, in steps; a
line near a step has keys of both. In a line of at most ``SHORT`` words each
word is a block, and the keys are all blocks but one, all but two neighbours and
all, so any one word replaced, added, left out, split or joined is found.

The net may miss lines whose edits touch every block. The README states the
recall measured against brute force.

The first occurrence (least document id, then least line number) of a group
stays; all others go. Lines of fewer than ``min_chars`` normalised characters
always stay, so do lines of documents with a null id, and a null text has no
lines. Rows that share an id are told apart by their texts; of equal rows each
keeps what the other keeps. Characters of scripts
without blanks are words of their own, and blanks between them do not count.
Lines and texts may have any length; edits are counted in a band. Extra columns
and an empty table are fine. Class names are 64-bit hashes.
"""

from __future__ import annotations

import itertools
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.bits import KeyFilter
from quernis.llm.edits import within
from quernis.llm.near_index import Rules, linked_components, repeated, sharing
from quernis.llm.scratch import Scratch
from quernis.llm.text import U64, located, mix, release, slices, text_bytes

MIN_CHARS = 20
SIMILARITY = 0.9
#: Pairs whose edits a task counts at once, and bytes of their texts.
TOGETHER, TOGETHER_BYTES = 15_000, 32 << 20
#: Likely pairs of a line in a crowd that are listed: no more rows than members, the others meet in tiles.
EACH = 1
#: Keys of a line by which a pair is known that another crowd compares.
KEYS = 8
#: Bytes of text whose words are hashed together: their arrays stay in a core's cache.
SLICE = 1 << 18
#: Words up to which each word of a line is a block.
SHORT = 12
#: Letters that a key stands for at least, in a short line and in blocks.
SHORT_LETTERS, LETTERS = 12, 18
#: The numbers of blocks that lines may have.
STEPS = np.array(sorted({2**k for k in range(2, 20)} | {3 * 2**k for k in range(20)}))

_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[:128] = 32
for _keep in (range(48, 58), range(97, 123), [10]):
    _SIGNS[list(_keep)] = list(_keep)
_PLACE, _COUNT, _ORDER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xA24BAED4963EE407)


class Lines:
    """The lines with at least one word of a batch of texts, as arrays."""

    def __init__(self, texts: pa.Array):
        self.data, off = text_bytes(pc.utf8_lower(texts))
        self.data = _SIGNS[self.data]
        self.word, self.begin, self.end, doc = located(self.data, off, lower=False, solo=True)
        ends = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(self.data == 10, out=ends[1:])
        number = ends[self.begin] - ends[off[doc]]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        #: Of each line: its first word, the text it stands in, its number there and how many words it has.
        self.first = np.flatnonzero(new)
        self.row, self.number = doc[self.first], number[self.first]
        self.n = np.diff(np.append(self.first, len(doc)))
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def letters(self) -> np.ndarray:
        """How many characters each word has."""
        lead = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:])
        return (lead[self.end] - lead[self.begin]).astype(np.int64)

    @cached_property
    def chars(self) -> np.ndarray:
        """How many characters each line has, with a blank between words."""
        return (np.add.reduceat(self.letters, self.first) if len(self.n) else self.n) + self.n - 1

    def nodes(self) -> np.ndarray:
        """A 64-bit name of each line's words in their order."""
        if not len(self.n):
            return np.zeros(0, np.int64)
        place = (np.arange(len(self.of)) - self.first[self.of]).astype(U64)
        return mix(np.add.reduceat(mix(self.word + place * _ORDER), self.first) + self.n.astype(U64)).view(np.int64)

    def normal(self, k: int) -> str:
        """The normalised text of line ``k``."""
        a, b = self.begin[self.first[k]], self.end[self.first[k] + self.n[k] - 1]
        return b" ".join(self.data[a:b].tobytes().split()).decode("utf-8", "replace")

    def keys(self, wanted: np.ndarray) -> pa.Array:
        """Index keys of the wanted lines, as packed 64-bit numbers; empty for others."""
        short = wanted & (self.n <= SHORT)
        found = [_short_keys(self, short)]
        here, more = _blocks(self.n), _blocks(np.maximum(self.n + 1, self.n * 1.1))
        found.append(_block_keys(self, wanted & ~short, here))
        found.append(_block_keys(self, (wanted & ~short & (more != here)) | (short & (self.n == SHORT)), more))
        key, of = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(of, kind="stable")
        at = 8 * np.searchsorted(of[order], np.arange(len(self.n) + 1)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(key[order].tobytes())])


def _blocks(n: np.ndarray) -> np.ndarray:
    """How many blocks a line of ``n`` words has: four words to a block at first, more in long lines."""
    return STEPS[np.minimum(np.searchsorted(STEPS, 4 * (n / 16) ** 0.75), len(STEPS) - 1)]


def _short_keys(lines: Lines, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(wanted[lines.of])
    of, letters = lines.of[at], lines.letters[at]
    h = mix(lines.word[at])
    first = np.searchsorted(of, of)
    all_h, all_l = np.zeros(len(wanted), U64), np.zeros(len(wanted), np.int64)
    np.add.at(all_h, of, h)
    np.add.at(all_l, of, letters)
    next_ = np.arange(len(of)) + 1
    pair = (next_ < len(of)) & (np.append(of, -1)[next_] == of)
    one = np.arange(len(of)) == first
    out = []
    for keep, less_h, less_l, less_n in ((one, U64(0), 0, 0), (all_l[of] - letters >= SHORT_LETTERS, h, letters, 1), (pair, h + np.append(h, U64(0))[next_], letters + np.append(letters, 0)[next_], 2)):
        left = all_l[of] - less_l
        keep = keep & ((left >= SHORT_LETTERS) | (less_n == 0))
        key = mix((all_h[of] - less_h) * U64(3) + (lines.n[of] - less_n).astype(U64))
        out.append((key[keep].view(np.int64), of[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The majority of each bit over the hashes of each group, ties as 0."""
    n, out = np.diff(np.append(first, len(h))), np.zeros(len(first), U64)
    step = 1 << 12
    for k in range(0, len(first), step):
        a, b = first[k], first[k + step] if k + step < len(first) else len(h)
        bits = np.unpackbits(h[a:b].view(np.uint8), bitorder="little").reshape(-1, 64)
        size, at = n[k : k + step, None], first[k : k + step] - a
        # Eight counts of up to 255 are added as one number.
        ones = np.add.reduceat(bits.view(U64), at, axis=0).view(np.uint8) if size.max() < 256 else np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[k : k + step] = np.packbits(2 * ones.astype(np.int32) > size, axis=1, bitorder="little").view(U64).ravel()
    return out


def _block_keys(lines: Lines, wanted: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each block of the wanted lines, together with the next ones where it has few letters."""
    at = np.flatnonzero(wanted[lines.of])
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, h, letters = lines.of[at], lines.word[at], lines.letters[at]
    block = (((h >> U64(32)) * blocks[of].astype(U64)) >> U64(32)).astype(np.int64)
    order = np.argsort((of.astype(U64) << U64(40)) | (np.minimum(block, (1 << 20) - 1).astype(U64) << U64(20)) | (h & U64((1 << 20) - 1)))
    of, h, letters, block = of[order], h[order], letters[order], block[order]
    # A word counts once in a block, else a frequent one would be all of its majority.
    other = np.ones(len(of), bool)
    other[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    of, h, letters, block = of[other], h[other], letters[other], block[other]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    sim, size = _majority(h, first), np.add.reduceat(letters, first)
    of, block = of[first], block[first]
    begin = np.searchsorted(of, of)
    n = np.searchsorted(of, of, "right") - begin
    key, total, place = sim.copy(), size.copy(), np.arange(len(of)) - begin
    for step in range(1, 8):
        few = np.flatnonzero((total < LETTERS) & (step < n))
        if not len(few):
            break
        to = begin[few] + (place[few] + step) % n[few]
        key[few] = mix(key[few]) + sim[to]
        total[few] += size[to]
    return mix(key + block.astype(U64) * _PLACE + blocks[of].astype(U64) * _COUNT).view(np.int64), of


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``(doc_id, text, of)``; ``of`` tells the texts of one id apart."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.where("doc_id is not null").withColumn("of", F.xxhash64("text"))


def occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """``(doc_id, of, line, node, chars, keys)`` of each line that counts; ``keys`` may be left out on a repeat."""

    def run(batches):
        for b in slices(batches, 1, SLICE):
            lines = Lines(b.column(1))
            long = lines.chars >= min_chars
            node = lines.nodes()
            once = np.zeros(len(node), bool)
            once[np.unique(node, return_index=True)[1]] = True
            keys = lines.keys(long & once)
            at = pa.array(np.flatnonzero(long))
            row = pa.array(lines.row)
            rows = [b.column(0).take(row), b.column(2).take(row), pa.array(lines.number), pa.array(node), pa.array(lines.chars), keys]
            yield pa.RecordBatch.from_arrays([c.take(at) for c in rows], ["doc_id", "of", "line", "node", "chars", "keys"])
        release()

    return _rows(docs, text, doc_id).mapInArrow(run, "doc_id bigint, of bigint, line bigint, node bigint, chars bigint, keys binary")


def _keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(data, np.int64, (off[-1] - off[0]) // 8, int(off[0])).copy(), np.diff(off) // 8


def _texts(docs: DataFrame, text: str, doc_id: str, nodes: DataFrame, occ: DataFrame) -> DataFrame:
    """``(node, norm)`` for the classes ``nodes(node)``, read from the first document that holds each."""
    n = nodes.count()
    pick = KeyFilter(nodes, "node", n)
    homes = _of_nodes(occ, nodes).join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    place = KeyFilter(homes.select(F.xxhash64("doc_id").alias("k")), "k", n)

    def run(batches):
        told = np.zeros(0, np.int64)
        for b in slices((x.filter(pa.array(place.may_hold(x.column(3).to_numpy()))) for x in batches), 1, SLICE):
            lines = Lines(b.column(1))
            node = lines.nodes()
            at = np.flatnonzero(pick.may_hold(node))
            at = at[np.unique(node[at], return_index=True)[1]]
            # A task tells a class once as long as it remembers.
            at = at[~np.isin(node[at], told)]
            told = np.concatenate([told, node[at]])[-(1 << 16) :]
            norm = pa.array([lines.normal(k) for k in at], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), norm], ["node", "norm"])
        release()

    rows = _rows(docs, text, doc_id).withColumn("k", F.xxhash64("doc_id"))
    got = rows.mapInArrow(run, "node bigint, norm string")
    return got.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("norm").alias("norm"))


def _of_nodes(occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """The occurrences that an exact join with ``nodes(node, ...)`` will want, and few others."""
    pick = KeyFilter(nodes.select("node"), "node", nodes.count())

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(pick.may_hold(b.column(3).to_numpy())))

    return occ.select("doc_id", "of", "line", "node").mapInArrow(run, "doc_id bigint, of bigint, line bigint, node bigint")


def _sifted(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The texts that an exact join with ``nodes(node)``, some ``n``, will want, and few others."""
    pick = KeyFilter(nodes, "node", n)

    def sift(batches):
        for b in batches:
            yield b.filter(pa.array(pick.may_hold(b.column(0).to_numpy())))

    return texts.select("node", "norm").mapInArrow(sift, "node bigint, norm string")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    # Of all texts only those of these pairs are moved.
    n = pairs.count()
    texts = _sifted(texts, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), 2 * n)
    x, y = (texts.select(F.col("node").alias(c), F.col("norm").alias(f"{c}_text"), F.char_length("norm").alias(f"{c}_chars")) for c in "ab")
    full = pairs.join(x, "a").join(y, "b")
    most = F.floor(F.greatest("a_chars", "b_chars") * (1 - similarity) + 1e-9).cast("int")
    full = full.withColumn("most", most).where(F.abs(F.col("a_chars") - F.col("b_chars")) <= F.col("most"))
    # Many pairs at once cost less each, as long as every core has some.
    tasks = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n // TOGETHER))

    def run(batches):
        held, rows, size = [], 0, 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                rows += b.num_rows
                size += b.nbytes
            if held and (b is None or rows > TOGETHER or size > TOGETHER_BYTES):
                t = pa.Table.from_batches(held).combine_chunks()
                near = within(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4).to_numpy())
                yield from t.select([0, 1]).filter(pa.array(near, pa.bool_())).to_batches()
                held, rows, size = [], 0, 0
        release()

    return full.select("a", "b", "a_text", "b_text", "most").coalesce(tasks).mapInArrow(run, "a bigint, b bigint")


def _alike(x: list[str], y: list[str], similarity: float) -> np.ndarray:
    most = [int(np.floor(max(len(a), len(b)) * (1 - similarity) + 1e-9)) for a, b in zip(x, y, strict=True)]
    return within(x, y, np.array(most, np.int64))


def _likely(key: int, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose lengths allow a link and that share no lesser key: a pair of many crowds is compared in one."""
    x, y = (np.ascontiguousarray(v).view(">i8").astype(np.int64) for v in (x, y))
    n, m = x[:, :1], y[:, :1].T
    may = np.abs(n - m) <= np.maximum(n, m) * (1 - similarity) + 1e-9
    # Keys are in order: the lesser ones stand in front.
    less, other = ((v[:, 1:] < key).sum(axis=1) for v in (x, y))
    if not less.any() or not other.any():
        return may
    a, b = x[:, 1 : 1 + less.max()], y[:, 1 : 1 + other.max()]
    i, j = np.nonzero(may & (less > 0)[:, None] & (other > 0)[None])
    for s in range(0, len(i), 1 << 14):
        p, q = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
        may[p, q] = ~((a[p][:, :, None] == b[q][:, None, :]) & (a[p] < key)[:, :, None]).any(axis=(1, 2))
    return may


def _signed(texts: DataFrame, crowd: DataFrame) -> DataFrame:
    """``(node, sig, bytes)``: the length of each text and the least ``KEYS`` keys of its crowds, as numbers of eight bytes."""
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    least = F.slice(F.array_sort(F.collect_set("key")), 1, KEYS)
    met = crowd.groupBy("node").agg(least.alias("least"))
    none = F.lit(2**63 - 1).cast("bigint")
    keys = [eight(F.coalesce(F.get("least", F.lit(k)), none)) for k in range(KEYS)]
    # Only the lengths are moved.
    sizes = texts.select("node", F.char_length("norm").cast("bigint").alias("chars"), F.octet_length("norm").alias("bytes"))
    return sizes.join(met, "node").select("node", F.concat(eight("chars"), *keys).alias("sig"), "bytes")


def repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, of, line, first_doc, first_line)``: every line that goes, and the occurrence that stays for it.

    Lines count from 0; ``of`` is ``xxhash64`` of the whole text.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    occ = scratch.put("lines", occurrences(docs, text, doc_id, min_chars))
    rows, total = occ.agg(F.count(F.lit(1)), F.sum(F.octet_length("keys").cast("bigint"))).first()
    keyed = occ.where("octet_length(keys) > 0").select("node", "keys", F.col("chars").alias("size"))
    pairs, crowd = sharing(scratch, keyed, _keys_of, (total or 0) // 8, round(100 * similarity), hashed=True)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowd.select("node")).distinct()
    texts = scratch.put("texts", _texts(docs, text, doc_id, scratch.put("nodes", nodes), occ))
    rules = Rules(
        verify=lambda some: _verified(some, texts, similarity),
        likely=lambda key, x, y: _likely(key, x, y, similarity),
        payload=lambda nodes: _sifted(texts, nodes, nodes.count()).withColumnRenamed("norm", "payload"),
        alike=lambda x, y: _alike(x, y, similarity),
        each=EACH,
    )
    labels = linked_components(scratch, pairs, crowd, _signed(texts, crowd), rules)
    again = repeated(scratch, occ.select("node"), rows)
    alone = again.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    named = scratch.put("named", labels.select("node", "label").union(alone))
    like = scratch.put("like", _of_nodes(occ, named).join(named, "node").drop("node"))
    # Written by itself, so that the join behind it can split the rows of a large group.
    kept = scratch.put("kept", like.groupBy("label").agg(F.min(F.struct("doc_id", "line", "of")).alias("kept")))
    here = F.struct("doc_id", "line", "of")
    met = like.join(kept, "label").where(here != F.col("kept"))
    return met.select("doc_id", "of", "line", F.col("kept.doc_id").alias("first_doc"), F.col("kept.line").alias("first_line"))


def summary(docs: DataFrame, gone: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped)``: a row for each document, ``dropped`` being its line numbers in order."""
    per = gone.groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("line")).alias("dropped"))
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    lines = F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(breaks + 1).cast("bigint")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("of"), lines.alias("n_lines"))
    dropped = F.coalesce("dropped", F.array().cast("array<bigint>"))
    return rows.join(per, ["doc_id", "of"], "left").select("doc_id", "n_lines", F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines, same columns; those that lose all their words go."""
    gone = repeated_lines(docs, text, doc_id, similarity, min_chars)
    per = gone.groupBy("doc_id", "of").agg(F.collect_set("line").alias("gone_lines")).withColumnsRenamed({"doc_id": "gone_id", "of": "gone_of"})
    # Columns go by place, so their names may be any.
    at, last = docs.columns.index(text), len(docs.columns)
    rows = docs.toDF(*[f"c{i}" for i in range(last)])
    same = (F.col(f"c{docs.columns.index(doc_id)}").cast("bigint") == F.col("gone_id")) & (F.xxhash64(F.col(f"c{at}").cast("string")) == F.col("gone_of"))
    joined = rows.join(per, same, "left").drop("gone_id", "gone_of")

    def run(batches):
        for b in batches:
            dropped = [set(v or ()) for v in b.column(last).to_pylist()]
            out = [x if x is None or not d else "\n".join(v for i, v in enumerate(x.split("\n")) if i not in d) for x, d in zip(b.column(at).to_pylist(), dropped, strict=True)]
            cols = b.columns[:-1]
            cols[at] = pa.array(out, pa.string())
            left = [not d or bool((x or "").strip()) for x, d in zip(out, dropped, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1]).filter(pa.array(left, pa.bool_()))

    return joined.mapInArrow(run, rows.schema).toDF(*docs.columns)
