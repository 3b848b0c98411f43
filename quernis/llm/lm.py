"""Cross-entropy difference of two matched language models.

Both are word bigram models over one vocabulary, the words of all texts (A-Z as
a-z), with the same smoothing: ``p(w|v) = (n(vw) + S p(w)) / (n(v) + S)`` and
``p(w) = (n(w) + 1/2) / (n + (V + 1) / 2)``, where a text's start is a context
and its end a word. The target model is counted on the target texts, the
background model on all texts, whose counts are scaled to the target's total so
that smoothing weighs alike in both. No document is judged by itself: its own
counts are taken out of both models before it is scored. A document's score is
the mean over its words and its end of target loss minus background loss, in
nats: the lower, the more it is like the target.

The models are tables as large as the corpus makes them, held by no task.
Documents are dealt to chunks of some megabytes. Each chunk asks for its
distinct n-grams and says how often it has each; tasks that own ranges of
n-grams add up what all chunks say and answer each question in its order; the
answers meet the chunk's texts again. Questions and answers travel packed, so a
frequent word is one number for a chunk, not a row for each place.

A null or empty text, or one of white space, has no words and null scores. If no
other target text is left, or no other text at all, the models are equal or
empty and the score is 0. Rows that share an id are texts of their own and
count as often as they stand; rows with a null id count too, but are no targets.
Texts may have any length: a longer one than a chunk is a chunk of its own.
There are no ties to break; extra columns are passed by; an empty table gives an
empty one. N-grams are named by hashes of 40 to 56 bits, sixteen more than the
corpus' bytes take, so some one in a hundred thousand shares its name with
another (beyond 56 bits, from a terabyte on, more do).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.bits import KeyFilter
from quernis.llm.scratch import Scratch
from quernis.llm.text import U64, mix, word_hashes

STRENGTH = 8.0
#: Bytes of text in a chunk, and n-grams in a range (at least as many as a range's chunks ask for on average).
CHUNK, RANGE = 4 << 20, 4 << 20
_START, _END = U64(0x5151515151515151), U64(0xE0E0E0E0E0E0E0E0)
#: Least and largest width of a hash, and how many bits it has beyond those of the corpus' size.
BITS, BEYOND = (40, 56), 16


class Grams:
    """The events of a batch of texts: each word and each end, after what it comes, and the distinct n-grams."""

    def __init__(self, texts: pa.Array, bits: int):
        h, at = word_hashes(texts)
        self.n = np.diff(at)
        full = self.n > 0
        #: Events of each text: its words and its end; none for a text without words.
        self.events = np.where(full, self.n + 1, 0)
        self.doc = np.repeat(np.arange(len(self.n)), self.events)
        ends = np.cumsum(self.events)[full] - 1
        word = np.full(len(self.doc), _END)
        is_word = np.ones(len(self.doc), bool)
        is_word[ends] = False
        word[is_word] = h
        before = np.empty_like(word)
        before[1:] = word[:-1]
        # What comes after an end is a start; it stands as often as the end and shares its count.
        before[(np.cumsum(self.events) - self.events)[full]] = _END
        # The lowest bit of a name tells a pair of words from a word.
        off = U64(64 - bits)
        one = (mix(word) >> off) << U64(1)
        two = ((mix(mix(before) * U64(0x9E3779B97F4A7C15) + word) >> off) << U64(1)) | U64(1)
        self.names, of = np.unique(np.concatenate([one, two]), return_inverse=True)
        #: For each event: the places of its word, its pair and its context in ``names``.
        self.word, self.pair = of[: len(one)].astype(np.int32), of[len(one) :].astype(np.int32)
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        if len(ends):
            context[(np.cumsum(self.events) - self.events)[full]] = self.word[ends[0]]
        self.context = context

    def counts(self, some: np.ndarray | None = None) -> np.ndarray:
        """How often each n-gram stands in the texts, or in those marked."""
        use = np.ones(len(self.doc), bool) if some is None else some[self.doc]
        return np.bincount(self.word[use], minlength=len(self.names)) + np.bincount(self.pair[use], minlength=len(self.names))

    def own(self, of: np.ndarray) -> np.ndarray:
        """For each event, how often the n-gram ``of`` it stands in the event's own text."""
        both = self.doc * np.int64(len(self.names)) + of
        order = np.argsort(both)
        both = both[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(both))).astype(np.int32)
        out = np.empty(len(both), np.int32)
        out[order] = np.repeat(n, n)
        return out


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0 in as few bytes each as the largest needs; the first byte says how many."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return out.view("<u8")[:, 0]


def counts_packed(x: np.ndarray) -> bytes:
    """Counts in a byte each; the few that are larger stand before them with their places."""
    large = np.flatnonzero(x >= 255)
    return len(large).to_bytes(4, "little") + large.astype("<u4").tobytes() + x[large].astype("<u8").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def counts_of(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, offset=4 + 12 * n).astype(np.uint64)
    out[np.frombuffer(raw, "<u4", n, 4)] = np.frombuffer(raw, "<u8", n, 4 + 4 * n)
    return out


def _bounds(ranges: int, bits: int) -> np.ndarray:
    return np.array([(k << (bits + 1)) // ranges for k in range(ranges + 1)], U64)


def chunked(docs: DataFrame, target_ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``(chunk, place, doc_id, in_target, text)``: rows in chunks of some ``CHUNK`` bytes, numbered within them."""
    scratch = Scratch(docs.sparkSession, "lm")
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    ids = scratch.put("target", ids)
    pick = KeyFilter(ids.select(F.xxhash64("doc_id").alias("k")), "k", ids.count())

    def sift(batches):
        for b in batches:
            may = pc.and_(pa.array(pick.may_hold(b.column(2).to_numpy())), pc.is_valid(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], may], ["doc_id", "text", "may"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("bigint")).alias("k"))
    rows = rows.mapInArrow(sift, "doc_id bigint, text string, may boolean")
    # Only texts that may be the target's are moved to be told exactly.
    told = rows.where("may").join(ids.withColumn("in_target", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("in_target", F.lit(False)).alias("in_target"), "text")
    rows = rows.where("not may").select("doc_id", F.lit(False).alias("in_target"), "text").union(told)

    def run(batches):
        chunk, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            chunks, places = [], []
            for t in b.column(2):
                n = len(t.as_buffer()) if t.is_valid else 0
                if place and size + n > CHUNK:
                    chunk, place, size = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(place)
                place, size = place + 1, size + n
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(places, pa.int64()), *b.columns], ["chunk", "place", "doc_id", "in_target", "text"])

    return rows.mapInArrow(run, "chunk bigint, place bigint, doc_id bigint, in_target boolean, text string")


def _runs(batches, chunk_at: int):
    """Tables of rows of one chunk that come one after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        chunk = b.column(chunk_at).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else []
        for s, e in zip(cut, cut[1:], strict=False):
            if held and held[0].column(chunk_at)[0].as_py() != chunk[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _questions(rows: DataFrame, ranges: int, bits: int) -> DataFrame:
    """A row for each stretch of a chunk that one task reads, and each range: the names asked for, and how often it has them."""
    bounds = _bounds(ranges, bits)

    def run(batches):
        for t in _runs(batches, 0):
            g = Grams(t.column("text").combine_chunks(), bits)
            every, target = g.counts(), g.counts(t.column("in_target").to_numpy(zero_copy_only=False))
            chunk, first, last = (t.column(c)[k].as_py() for c, k in (("chunk", 0), ("place", 0), ("place", -1)))
            cut = np.searchsorted(g.names, bounds)
            for k in np.flatnonzero(np.diff(cut)):
                s, e = cut[k], cut[k + 1]
                cells = [[chunk], [first], [last], [int(k)], [narrow(np.diff(g.names[s:e], prepend=bounds[k]))], [counts_packed(every[s:e])], [counts_packed(target[s:e])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cells, _ASKED.types, strict=True)], _ASKED.names)

    return rows.mapInArrow(run, "chunk bigint, first bigint, last bigint, range int, names binary, n binary, target binary")


_ASKED = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("range", pa.int32()), ("names", pa.binary()), ("n", pa.binary()), ("target", pa.binary())])


def _answers(asked: DataFrame, ranges: int, bits: int) -> DataFrame:
    """The sums in each question's order; ``words``, ``events`` and ``of_target`` sum up a range's words and stand once for it."""

    bounds = _bounds(ranges, bits)

    def run(batches):
        for range_ in _by_range(batches):
            who, names, n, target = zip(*range_, strict=True)
            names = [np.cumsum(wide(x)) for x in names]  # from the range's beginning
            size = np.cumsum([len(x) for x in names])
            distinct, of = np.unique(np.concatenate(names), return_inverse=True)
            every, of_target = (np.bincount(of, np.concatenate([counts_of(x) for x in c]), len(distinct)).astype(np.uint64) for c in (n, target))
            single = (distinct + bounds[who[0][3]]) & U64(1) == 0
            once = [int(single.sum()), int(every[single].sum()), int(of_target[single].sum())]
            for (chunk, first, last, k), e, x in zip(who, size, names, strict=True):
                s = e - len(x)
                cells = [[chunk], [first], [last], [k], *[[counts_packed(v[of[s:e]])] for v in (every, of_target)], *[[v] for v in once]]
                kinds = [*_ASKED.types[:4], pa.binary(), pa.binary(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cells, kinds, strict=True)], ["chunk", "first", "last", "range", "n", "target", "words", "events", "of_target"])
                once = [0, 0, 0]

    return asked.repartitionById(ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(run, "chunk bigint, first bigint, last bigint, range int, n binary, target binary, words bigint, events bigint, of_target bigint")


def _by_range(batches):
    now, held = None, []
    for b in batches:
        for *who, names, n, target in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and who[3] != now:
                yield held
                held = []
            now = who[3]
            held.append((who, names, n, target))
    if held:
        yield held


def losses(n: tuple[np.ndarray, np.ndarray, np.ndarray], total: np.ndarray, words: int, scale: np.ndarray | float, strength: float) -> np.ndarray:
    """``-log p(w|v)`` from the counts of words, pairs and contexts, each times ``scale``."""
    word, pair, context = (np.maximum(x, 0) * scale for x in n)
    p = (word + 0.5) / (np.maximum(total, 0) * scale + 0.5 * (words + 1))
    return -np.log((pair + strength * p) / (context + strength))


def score(g: Grams, n: np.ndarray, target: np.ndarray, in_target: np.ndarray, total: int, of_target: int, words: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's mean losses under target and background model, its own counts left out."""
    places = (g.word, g.pair, g.context)
    own = [g.own(x) for x in places]
    mine, events = in_target[g.doc], g.events[g.doc]
    rest, rest_target = total - events, of_target - np.where(mine, events, 0)
    every = losses(tuple(n[x] - o for x, o in zip(places, own, strict=True)), rest, words, np.where(rest > 0, rest_target / np.maximum(rest, 1), 0.0), strength)
    only = losses(tuple(target[x] - o * mine for x, o in zip(places, own, strict=True)), rest_target, words, 1.0, strength)
    size = np.maximum(g.events, 1)
    return tuple(np.bincount(g.doc, x, len(g.n)) / size for x in (only, every))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", strength: float = STRENGTH) -> DataFrame:
    """``(doc_id, n_tokens, score, target_loss, background_loss, in_target)``: a row for each document.

    ``target_ids`` has one column, the ids of the target texts. Losses are nats a word.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    rows = scratch.put("chunks", chunked(docs, target_ids, text, doc_id))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    # An n-gram for each three bytes or so: a word and a pair for each five or six.
    ranges = max(1, -(-size // (3 * RANGE)))
    bits = min(max(size.bit_length() + BEYOND, BITS[0]), BITS[1])
    answers = scratch.put("answers", _answers(_questions(rows, ranges, bits), ranges, bits))
    words, total, of_target = (v or 0 for v in answers.agg(F.sum("words"), F.sum("events"), F.sum("of_target")).first())
    fields = "chunk bigint, place bigint, doc_id bigint, in_target boolean, text string, first bigint, last bigint, range int, n binary, target binary"
    none = lambda names: [F.lit(None).alias(c) for c in names]
    texts = rows.select("chunk", "place", "doc_id", "in_target", "text", *none(["first", "last", "range", "n", "target"]))
    told = answers.select("chunk", F.lit(None).alias("place"), *none(["doc_id", "in_target", "text"]), "first", "last", "range", "n", "target")
    met = texts.union(told).to(_schema(docs, fields)).repartition("chunk").sortWithinPartitions("chunk", "place", "first", "range")

    def run(batches):
        for t in _runs(batches, 0):
            told = t.filter(pc.is_valid(t.column("first"))).to_pylist()
            texts = t.filter(pc.is_valid(t.column("place")))
            left = np.ones(texts.num_rows, bool)
            for first, last in sorted({(r["first"], r["last"]) for r in told}):
                part = texts.slice(first, last - first + 1)
                left[first : last + 1] = False
                some = [r for r in told if r["first"] == first]
                g = Grams(part.column("text").combine_chunks(), bits)
                n, target = (np.concatenate([counts_of(r[c]) for r in some]).astype(np.float64) for c in ("n", "target"))
                yield _scored(g, part, *score(g, n, target, part.column("in_target").to_numpy(zero_copy_only=False), total, of_target, words, strength))
            if left.any():  # texts without a word ask for nothing
                part = texts.filter(pa.array(left))
                g = Grams(part.column("text").combine_chunks(), bits)
                yield _scored(g, part, *[np.zeros(len(g.n))] * 2)

    return met.mapInArrow(run, "doc_id bigint, n_tokens bigint, score double, target_loss double, background_loss double, in_target boolean")


def _schema(docs: DataFrame, fields: str):
    return docs.sparkSession.createDataFrame([], fields).schema


def _scored(g: Grams, part: pa.Table, only: np.ndarray, every: np.ndarray) -> pa.RecordBatch:
    empty = g.n == 0
    cells = [pa.array(np.round(x, 6), mask=empty) for x in (only - every, only, every)]
    ids, flags = (part.column(c).combine_chunks() for c in ("doc_id", "in_target"))
    return pa.RecordBatch.from_arrays([ids, pa.array(g.n.astype(np.int64)), *cells, flags], ["doc_id", "n_tokens", "score", "target_loss", "background_loss", "in_target"])
