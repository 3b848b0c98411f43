"""Chroma audio fingerprints and the alignment of recordings.

A recording's frames (Hann window, FFT) become twelve pitch-class energies.
Filters that compare areas of the time-by-class image, taken from its integral
image, give two bits each by three thresholds; sixteen filters make one packed
32-bit integer for each position. The thresholds are quartiles over all
positions of all recordings, from a histogram that tasks add up.

Recordings of equal integers form a class, and only classes are compared. They
are aligned by equal integers: for each pair the histogram of offsets is taken
over the places where an integer begins (so silence and held notes count once),
its peak is the alignment, and the share of differing bits over the overlap
decides. Queries are gone through in blocks of at most some ``BLOCK`` integers,
each block against all classes, so no pair table is built.

Audio is a WAV file (16 bit; several channels are averaged). Null, empty, torn
or too short audio has no integers and aligns with nothing; silence has equal
integers like any other sound. Ties of the peak go to the offset nearest to
zero, then the lesser. Rows that share an id are all compared, rows with a null
id too. Audio may have any length: one recording stands in memory at a time.
Extra columns are passed by; an empty table gives an empty one.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernis.llm.scratch import Scratch

WINDOW, HOP, LOWEST, HIGHEST = 512, 128, 220.0, 1760.0
FILTERS, SPAN = 16, 8
#: Integers of queries in a block, and hits that are counted at once.
BLOCK, HITS = 1 << 20, 1 << 21
#: Filters give values within ``-SPAN..SPAN``, told apart in so many steps.
STEPS = 1 << 14
MIN_VOTES, MAX_ERROR = 2, 0.25


def samples(audio: bytes | None) -> tuple[np.ndarray, int]:
    """The mono signal in -1..1 and its rate; empty if it is no such WAV file."""
    try:
        with wave.open(io.BytesIO(audio or b"")) as w:
            if w.getsampwidth() != 2 or w.getframerate() <= 0:
                return np.zeros(0), 1
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
            c = w.getnchannels()
            return x[: len(x) // c * c].reshape(-1, c).mean(axis=1) / 32768.0, w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 1


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch-class energies, each frame of sum 1 unless silent."""
    if len(x) < WINDOW:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    hz = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    used = (hz >= LOWEST) & (hz <= HIGHEST)
    classes = np.zeros((WINDOW // 2 + 1, 12))
    classes[np.flatnonzero(used), np.rint(12 * np.log2(hz[used] / 440.0)).astype(int) % 12] = 1
    out = np.zeros((len(frames), 12))
    for k in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[k : k + 4096] * np.hanning(WINDOW), axis=1)) ** 2
        out[k : k + 4096] = power @ classes
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 0.0)


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    out[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    return out


def _areas(k: int) -> list[tuple[int, int, int, int, int]]:
    """Filter ``k``: areas (from frame, to frame, from class, to class, sign) within ``SPAN`` frames and twelve classes."""
    low, high = 3 * (k % 4), 3 * (k % 4) + 3
    half = SPAN // 2
    return [
        [(0, SPAN, low, high, 1), (0, SPAN, (low + 6) % 12, (low + 6) % 12 + 3, -1)],
        [(0, half, low, high, 1), (half, SPAN, low, high, -1)],
        [(0, half, low, low + 1, 1), (half, SPAN, low + 1, low + 2, 1), (0, half, low + 1, low + 2, -1), (half, SPAN, low, low + 1, -1)],
        [(half // 2, half + half // 2, low, high, 2), (0, SPAN, low, high, -1)],
    ][k // 4]


def responses(image: np.ndarray) -> np.ndarray:
    """Positions by filters: sums of signed areas, each from four corners of the integral image."""
    total, n = integral(image), max(len(image) - SPAN + 1, 0)
    at = np.arange(n)
    out = np.zeros((n, FILTERS))
    for k in range(FILTERS):
        for a, b, c, d, sign in _areas(k):
            out[:, k] += sign * (total[at + b, d] - total[at + a, d] - total[at + b, c] + total[at + a, c])
    return out


def stepped(r: np.ndarray) -> np.ndarray:
    """Filter values as whole steps."""
    return np.clip((np.round(r, 9) + SPAN) * (STEPS / (2 * SPAN)), 0, STEPS - 1).astype(np.uint16)


def packed(steps: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two Gray-coded bits from each filter's quarter, sixteen filters to an integer."""
    out = np.zeros(len(steps), np.uint32)
    for k in range(FILTERS):
        quarter = (steps[:, k, None] > cuts[k]).sum(axis=1).astype(np.uint32)
        out |= (quarter ^ (quarter >> np.uint32(1))) << np.uint32(2 * k)
    return out


def quartiles(counts: np.ndarray) -> np.ndarray:
    """For each filter the steps at which a quarter, a half and three quarters of its values are reached."""
    total = counts.sum(axis=1, keepdims=True)
    reached = counts.cumsum(axis=1)
    return np.stack([(reached < total * q).sum(axis=1) for q in (0.25, 0.5, 0.75)], axis=1)


def fingerprints(rows: DataFrame, audio: str = "audio", rec_id: str = "rec_id") -> DataFrame:
    """``(rec_id, prints)``: the integers as unsigned 32-bit little-endian numbers."""
    scratch = Scratch(rows.sparkSession, "filters")

    def heard(batches):
        for b in batches:
            for name, a in zip(b.column(0), b.column(1), strict=True):
                steps = stepped(responses(chroma(*samples(a.as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], pa.int64()), pa.array([steps.astype("<u2").tobytes()], pa.binary())], ["rec_id", "steps"])

    def many(batches):
        """Recordings together, so that a batch is not one row."""
        held, size = [], 0
        for b in heard(batches):
            held.append(b)
            size += b.nbytes
            if size > 1 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    source = rows.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(audio).cast("binary").alias("audio"))
    filters = scratch.put("filters", source.mapInArrow(many, "rec_id bigint, steps binary"))

    def count(batches):
        counts = np.zeros((FILTERS, STEPS), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                steps = np.frombuffer(raw, "<u2").reshape(-1, FILTERS)
                for k in range(FILTERS):
                    counts[k] += np.bincount(steps[:, k], minlength=STEPS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts.ravel()[at])], ["at", "n"])

    # At most FILTERS * STEPS numbers reach the driver.
    got = filters.select("steps").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(FILTERS * STEPS, np.int64)
    counts[got.column("at").to_numpy()] = got.column("n").to_numpy()
    cuts = quartiles(counts.reshape(FILTERS, STEPS))

    def run(batches):
        for b in batches:
            prints = [packed(np.frombuffer(raw, "<u2").reshape(-1, FILTERS), cuts).astype("<u4").tobytes() for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], ["rec_id", "prints"])

    return filters.mapInArrow(run, "rec_id bigint, prints binary")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of differing bits where ``b`` shifted by ``offset`` overlaps ``a``: position ``i + offset`` of a meets ``i`` of b."""
    lo, hi = max(0, -offset), min(len(b), len(a) - offset)
    if hi <= lo:
        return 1.0
    return float(np.bitwise_count(a[lo + offset : hi + offset].astype(np.uint32) ^ b[lo:hi].astype(np.uint32)).sum()) / (32 * (hi - lo))


def _begins(p: np.ndarray) -> np.ndarray:
    """Where an integer differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)


class _Block:
    """Queries as a sorted list of the integers that begin in them."""

    def __init__(self, ids: list[int], prints: list[bytes]):
        self.ids = ids
        self.prints = [np.frombuffer(p, "<u4") for p in prints]
        begins = [_begins(p) for p in self.prints]
        value = np.concatenate([p[b] for p, b in zip(self.prints, begins, strict=True)])
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.which = np.repeat(np.arange(len(begins)), [len(b) for b in begins])[order]
        self.where = np.concatenate(begins)[order]

    def votes(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, offset and votes of each offset at which some integers of ``p`` begin alike."""
        at = _begins(p)
        lo, hi = np.searchsorted(self.value, p[at], "left"), np.searchsorted(self.value, p[at], "right")
        n = hi - lo
        span = np.int64(1) << 40
        found, counts, begin, done = [], [], 0, np.cumsum(n)
        while begin < len(at):  # some hits at a time
            end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + HITS, "right")))
            m = n[begin:end]
            hit = np.repeat(lo[begin:end] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key, k = np.unique(self.which[hit] * span + (self.where[hit] - np.repeat(at[begin:end], m) + span // 2), return_counts=True)
            found.append(key)
            counts.append(k)
            begin = end
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        return key // span, key % span - span // 2, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)

    def aligned(self, p: np.ndarray, min_votes: int, max_error: float):
        which, offset, votes = self.votes(p)
        best = np.lexsort((offset, np.abs(offset), -votes, which))
        for i in best[np.flatnonzero(np.diff(which[best], prepend=-1))]:
            if votes[i] >= min_votes and (e := bit_errors(self.prints[which[i]], p, int(offset[i]))) <= max_error:
                yield self.ids[which[i]], int(offset[i]), int(votes[i]), round(e, 6)


MATCHES = "query_class bigint, class_id bigint, offset int, votes int, bit_error double"


def classes(scratch: Scratch, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(row, rec_id, class_id)`` for each row, and ``(class_id, prints)`` for each class.

    A class is named by the number of one of its rows, so rows that share an id stay apart.
    """
    rows = scratch.put("rows", prints.select(F.monotonically_increasing_id().alias("row"), "rec_id", "prints", F.sha1("prints").alias("of")))
    least = scratch.put("least", rows.where("octet_length(prints) > 0").groupBy("of").agg(F.min("row").alias("class_id")))
    members = scratch.put("members", rows.select("row", "rec_id", "of").join(least, "of", "left").select("row", "rec_id", "class_id"))
    return members, rows.join(least, (rows.of == least.of) & (rows.row == least.class_id)).select("class_id", "prints")


def alignments(scratch: Scratch, found: DataFrame, queries: DataFrame, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """A row for each query class and class that align, a class and itself among them: see ``MATCHES``.

    ``found(class_id, prints)`` are all classes, ``queries(class_id)`` those to
    look for. Query position ``i + offset`` meets position ``i``. The driver
    holds one block of queries at a time.
    """
    spark = found.sparkSession
    found = scratch.put("classes", found)
    asked = scratch.put("queries", found.join(queries.distinct(), "class_id").withColumn("h", F.xxhash64("class_id")))
    size = asked.agg(F.sum(F.octet_length("prints").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK)))
    out = None
    for k in range(blocks):
        # A hash deals the queries out, so a block holds some BLOCK integers, or one long query more.
        part = asked.where(F.pmod("h", F.lit(blocks)) == k).toArrow()
        if not part.num_rows:
            continue
        block = spark.sparkContext.broadcast((part.column("class_id").to_pylist(), part.column("prints").to_pylist()))

        def run(batches, block=block):
            index = _Block(*block.value)
            for b in batches:
                rows = [(q, c, o, v, e) for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for q, o, v, e in index.aligned(np.frombuffer(raw, "<u4"), min_votes, max_error)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_class", "class_id", "offset", "votes", "bit_error"])

        got = scratch.put("matches", found.mapInArrow(run, MATCHES))
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def search(prints: DataFrame, is_query: Column, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """``(rec_id, class_id, n_links, best_query, offset, votes, bit_error)``: a row for each recording.

    ``is_query`` tells queries by ``rec_id``. ``class_id`` is the least id of the
    recordings with the same integers, null without integers. ``n_links`` counts
    the queries, other than the row itself, that align with the recording; the
    best is one of another row with the fewest bit errors, then most votes, then
    the least class id.
    """
    scratch = Scratch(prints.sparkSession, "chroma")
    members, found = classes(scratch, prints)
    asks = members.where("class_id is not null").where(F.coalesce(is_query, F.lit(False)))
    asked = asks.groupBy("class_id").agg(F.count(F.lit(1)).alias("asking"))
    met = scratch.put("met", alignments(scratch, found, asks.select("class_id"), min_votes, max_error))
    named = members.where("class_id is not null").groupBy("class_id").agg(F.min("rec_id").alias("least"))
    met = met.join(asked.withColumnRenamed("class_id", "query_class"), "query_class").join(named.select(F.col("class_id").alias("query_class"), F.col("least").alias("query")), "query_class")
    # A query that is alone in its class has itself for company only there.
    own = F.col("query_class") == F.col("class_id")
    best = F.struct("bit_error", (-F.col("votes")).alias("few"), "query", "offset", "votes")
    other = met.where(~own).groupBy("class_id").agg(F.sum("asking").alias("links"), F.min(best).alias("best"))
    self_ = met.where(own).select("class_id", F.col("asking").alias("own_links"), best.alias("own_best"))
    mine = members.withColumn("asks", F.coalesce(is_query, F.lit(False)).cast("bigint"))
    out = mine.join(named, "class_id", "left").join(other, "class_id", "left").join(self_, "class_id", "left")
    company = F.coalesce(F.col("own_links") - F.col("asks"), F.lit(0))
    best = F.when(company > 0, F.least(F.coalesce("own_best", "best"), F.coalesce("best", "own_best"))).otherwise(F.col("best"))
    out = out.withColumn("top", best)
    return out.select("rec_id", F.col("least").alias("class_id"), (F.coalesce("links", F.lit(0)) + company).cast("bigint").alias("n_links"), F.col("top.query").alias("best_query"), F.col("top.offset").alias("offset"), F.col("top.votes").alias("votes"), F.col("top.bit_error").alias("bit_error"))


def melody(vector: np.ndarray, rate: int = 4000, note: int = 128) -> bytes:
    """A WAV file with one note for each component: the greater, the higher within an octave."""
    x = np.nan_to_num(np.asarray(vector, float))
    scale = np.sqrt(np.mean(x * x)) or 1.0
    pitch = np.clip(np.floor(6 + 3 * x / scale), 0, 11)
    phase = 2 * np.pi * np.cumsum(np.repeat(440.0 * 2 ** (pitch / 12) / rate, note))
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((0.5 * np.sin(phase) * 32767).astype("<i2").tobytes())
    return sound.getvalue()


def recordings(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``(rec_id, audio)``: each vector played as a melody, for tables that hold no sound."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([melody(v) if v else None for v in part.column(1).to_pylist()], pa.binary())], ["rec_id", "audio"])

    return vectors.select(F.col(vec_id).cast("bigint").alias("rec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "rec_id bigint, audio binary")
