"""Language identification by error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over hashed byte
trigrams (naive Bayes, one weight for each trigram). A text's mean weight for a
bit is that bit's margin. Decoding sums, for every language, the logistic loss
of each margin against the codeword's bit, weighted by how well that classifier
is expected to tell that language, and takes the least. Close runners-up are
flagged as ambiguous.

Trigram counts cover all training rows; weights are whole numbers, so a text
scores alike in any batch. A weight is at most ``CLIP``: a trigram that one side
of a bit never has tells no more than one that is some fifty times as frequent.
``und`` is the answer for null, empty and letterless texts, and for all texts if
nothing was learned. Rows with null language are not learned from. Texts may
have any length: they are read in pieces. Extra columns are passed by or kept,
repeated rows count as often as they stand, equal losses go to the language that
is first by code point, and an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.scratch import quoted
from quernis.llm.text import PIECE, text_bytes

BUCKETS = 1 << 15
UNIT = 4096
#: Weights, natural logarithms of two frequencies' ratio, lie within these bounds.
CLIP = 4
#: Below this relative gap between the two least losses an answer counts as ambiguous.
AMBIGUOUS = 0.1
#: Columns of a code: all splits up to this many languages, else this many for each doubling.
EXHAUSTIVE, COLUMNS = 6, 15

_KIND = np.full(256, 32, np.uint32)
_KIND[97:123] = np.arange(97, 123)
_KIND[65:91] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray):
    """For pieces of the texts: bucket of the trigram around each byte, first text and bounds of texts in it.

    Digits, signs and white space count as one blank; bucket 0 is for blanks.
    """
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        lo, hi = max(a - 1, 0), min(b + 1, len(data))
        k = _KIND[data[lo:hi]]
        mid = k[a - lo : len(k) - (hi - b)]
        before, after = np.full(b - a, 32, np.uint32), np.full(b - a, 32, np.uint32)
        before[1 if lo == a else 0 :] = k[: b - a - 1 if lo == a else b - a]
        n = len(k) - (a - lo) - 1
        after[:n] = k[a - lo + 1 :][: b - a]
        first, last = np.searchsorted(off, a, "right") - 1, np.searchsorted(off, b, "left")
        bounds = np.clip(off[first : last + 1], a, b) - a
        starts = bounds[1:-1]
        starts = starts[(starts > 0) & (starts < b - a)]
        before[starts] = 32
        after[starts - 1] = 32
        if bounds[0] == 0 and off[first] == a:
            before[0] = 32
        if off[last] == b:
            after[-1] = 32
        h = (before * np.uint32(0x9E3779B1)) ^ (mid * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        yield np.where(mid == 32, 0, h % (BUCKETS - 1) + 1), first, bounds


def sums(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text the sums of each row of ``weights`` over its trigrams."""
    data, off = text_bytes(texts)
    out = np.zeros((len(off) - 1, len(weights)), np.int64)
    for bucket, first, bounds in trigrams(data, off):
        full = np.flatnonzero(np.diff(bounds))
        for j, w in enumerate(weights):
            out[first + full, j] += np.add.reduceat(w[bucket], bounds[full], dtype=np.int64)
    return out


def codewords(n: int) -> np.ndarray:
    """``n`` rows of -1 and 1: all splits for few languages, else far-apart random ones."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if k == 0 else (-1 if (s >> (k - 1)) & 1 else 1) for s in splits] for k in range(n)], np.int8)
    rng, best, apart = np.random.Generator(np.random.PCG64(n)), None, -1
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], np.int8), (n, int(COLUMNS * np.ceil(np.log2(n)))))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        # Products of codewords fall with their distance; a row is not compared with itself.
        like = m.astype(np.float32) @ m.T.astype(np.float32) - 4.0 * m.shape[1] * np.eye(n, dtype=np.float32)
        d = int((m.shape[1] - like.max()) // 2)
        if d > apart:
            best, apart = m, d
    if apart < 1:
        raise ValueError("two languages have one codeword")
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: Whole-number weights, bits by buckets; the last row counts letters.
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS), np.int32))
    #: Expected margin of each bit on text of each language.
    expected: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def decode(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest language and the relative gap to the next."""
        n = np.maximum(total[:, -1:], 1) * UNIT
        z = (total[:, None, :-1] / n[:, None, :]) * self.code[None] / np.maximum(np.abs(self.expected), 1e-9)[None]
        trust = np.maximum(self.expected * self.code, 1e-9)
        trust = trust / trust.sum(axis=1, keepdims=True)
        loss = (np.logaddexp(0, -4 * z) * trust[None]).sum(axis=2)
        best = loss.argmin(axis=1)
        if len(self.langs) < 2:
            return best, np.ones(len(best))
        two = np.partition(loss, 1, axis=1)
        return best, np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-300), 0, 1)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a language. To the driver come counts: ``BUCKETS`` numbers a language at most."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            data, off = text_bytes(b.column(0))
            names = b.column(1).to_pylist()
            codes = {v: i for i, v in enumerate(dict.fromkeys(names))}
            of = np.array([codes[v] for v in names])
            table = np.zeros(len(codes) * BUCKETS, np.int64)
            for bucket, first, bounds in trigrams(data, off):
                lang_of = np.repeat(of[first : first + len(bounds) - 1], np.diff(bounds))
                table += np.bincount(lang_of * BUCKETS + bucket, minlength=len(table))
            for v, i in codes.items():
                part = table[i * BUCKETS : (i + 1) * BUCKETS]
                seen[v] = seen[v] + part if v in seen else part
        for v, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    got = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()), key=lambda s: s.encode())
    if not langs:
        return Model([])
    counts = np.zeros((len(langs), BUCKETS))
    at = {v: i for i, v in enumerate(langs)}
    counts[[at[v] for v in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    counts[:, 0] = 0
    p = counts + 0.5
    p[:, 0] = 0
    p = p / p.sum(axis=1, keepdims=True)
    code = codewords(len(langs)).astype(float)
    floor = 1e-9
    weights, expected = [], np.zeros(code.shape)
    for j in range(code.shape[1]):
        yes, no = code[:, j] > 0, code[:, j] < 0
        w = np.log((p[yes].mean(axis=0) + floor) / ((p[no].mean(axis=0) if no.any() else p[yes].mean(axis=0)) + floor))
        w[0] = 0
        weights.append(np.rint(np.clip(w, -CLIP, CLIP) * UNIT).astype(np.int32))
        expected[:, j] = p @ (weights[-1] / UNIT)
    letters = np.ones(BUCKETS, np.int32)
    letters[0] = 0
    return Model(langs, code, np.array([*weights, letters]), expected)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``(lang_pred, score, ambiguous)``; only the text is looked at."""
    # The text travels once, whether it is kept or not.
    carried = [*keep] if text in keep else [*keep, text]
    at = carried.index(text)
    named = docs.select(*[F.col(quoted(c)) for c in carried])
    kept = named.toDF(*[f"c{i}" for i in range(len(carried))])

    kept_names = kept.columns[: len(keep)]

    def run(batches):
        for b in batches:
            texts = b.column(at)
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model.langs:
                best, score = model.decode(sums(texts, model.weights))
                pred = np.where(known, np.array(model.langs, object)[best], "und")
            else:
                pred, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            sure = known & bool(model.langs)
            score = np.where(sure, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sure & (score < AMBIGUOUS))], [*kept_names, "lang_pred", "score", "ambiguous"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean").toDF(*keep, "lang_pred", "score", "ambiguous")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2
