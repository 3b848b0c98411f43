import io
import json
import math
import wave
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernis.llm import chroma, lm, order
from quernis.llm.scratch import Scratch
from tests.llm.common import DOCS, awkward, corpus, words

P = pytest.importorskip("public_tokenizers")


def loss(text, others, words_in, smooth=8.0, scale=1.0):
    """Mean loss of a text under a bigram model of other texts, with counts from plain dictionaries."""
    word, pair = Counter(), Counter()
    for t in others:
        w = [*words(t), None] if words(t) else []
        word.update(w)
        pair.update(zip([None, *w], w, strict=False))
    total, out = sum(word.values()), []
    mine = [*words(text), None]
    for v, w in zip([None, *mine], mine, strict=False):
        p = (word[w] * scale + 0.5) / (total * scale + 0.5 * (words_in + 1))
        out.append(-math.log((pair[v, w] * scale + smooth * p) / (word[v] * scale + smooth)))
    return sum(out) / len(out)


def events(texts):
    return sum(len(words(t)) + 1 for t in texts if words(t))


def test_scores_against_plain_models(spark, monkeypatch):
    """Chunks and ranges of a few rows; a document's own counts are left out."""
    monkeypatch.setattr(lm, "RANGE", 2000)
    rows = list({r[0]: r for r in corpus(41) if r[0] is not None and len(r[1] or "") < 50_000}.values()) + [(None, "a text without an id", "en", "a", 1)]
    good = [r[0] for r in rows if r[0] is not None and r[0] % 2 == 0]
    df = awkward(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = {r.doc_id: r for r in lm.cross_entropy_difference(df, spark.createDataFrame([(g,) for g in [*good, *good, None, 10**6]], "x bigint")).collect()}
    assert len(got) == len(rows)
    vocabulary = len({w for r in rows for w in words(r[1])}) + 1
    for i, (d, t, *_) in enumerate(rows):
        r, mine = got[d], words(t)
        assert r.n_tokens == len(mine) and r.in_target == (d in good)
        if not mine:
            assert r.score is None and r.target_loss is None
        elif i % 3 == 0:
            rest = [x[1] for k, x in enumerate(rows) if k != i]
            target = [x[1] for k, x in enumerate(rows) if k != i and x[0] in good]
            only, every = loss(t, target, vocabulary), loss(t, rest, vocabulary, scale=events(target) / events(rest))
            assert (r.target_loss, r.background_loss) == (pytest.approx(only, abs=1e-5), pytest.approx(every, abs=1e-5))
            assert r.score == pytest.approx(only - every, abs=2e-5)


def test_scores_of_odd_tables(spark):
    ids = spark.createDataFrame([], "x bigint")
    assert not lm.cross_entropy_difference(spark.createDataFrame([], DOCS), ids).collect()
    got = lm.cross_entropy_difference(spark.createDataFrame(corpus(42), DOCS), ids).collect()
    assert len(got) == len(corpus(42)) and all(r.score is None or abs(r.score) < 1e-9 for r in got)
    blank = lm.cross_entropy_difference(spark.createDataFrame([(1, None, "", "", 0), (2, " ", "", "", 0)], DOCS), ids).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in blank) == [(1, 0, None), (2, 0, None)]


def test_packed_numbers_round_trip():
    for x in ([], [0], [1, 255], [256, 3], [2**63, 1]):
        assert lm.wide(lm.narrow(np.array(x, np.uint64))).tolist() == x
        assert lm.counts_of(lm.counts_packed(np.array(x, np.uint64))).tolist() == x


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_slots_are_a_permutation(n, key):
    assert sorted(order.slots(np.arange(n), n, key)) == list(range(n))


def test_orders_differ_by_key_and_look_random():
    a, b = order.slots(np.arange(4096), 4096, 1), order.slots(np.arange(4096), 4096, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(4096))[0, 1]) < 0.1


def test_shards_hold_every_sequence_at_its_slot(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus(44)
    s = Scratch(spark, "t")
    folder = s.folder("shards")
    got = order.materialise(awkward(spark.createDataFrame(rows, DOCS)), folder, P.path("byte_bpe_50k.json"), length=16, per_shard=50, key=7).collect()
    store, top = order._store(folder)
    with store.open_input_stream(f"{top}/order.json") as f:
        o = json.loads(f.read())
    assert o["sequences"] == len(got) and sorted(r.slot for r in got) == list(range(len(got)))
    table = order.read_slots(folder, 0, 10**9)
    assert (order.read_slots(folder, 45, 20) == table[45:65]).all() and len(order.read_slots(folder, len(got), 5)) == 0
    ids = {}
    for d, t, *_ in rows:
        x = plain.encode(t, add_special_tokens=False).ids if t else []
        for k in range(0, len(x), 16):
            ids.setdefault((d, k), []).append(x[k : k + 16])
    assert sum(map(len, ids.values())) == len(got)
    for r in got:
        assert table[r.slot][: r.n_tokens].tolist() in ids[(r.doc_id, r.start)] and not table[r.slot][r.n_tokens :].any()
        assert (r.shard, r.position) == (r.slot // 50, r.slot % 50 * o["stride"])
    # A shuffled input may come in other partitions each time: it is written first.
    again = order.materialise(spark.createDataFrame(rows, DOCS).repartition(5), s.folder("again"), P.path("byte_bpe_50k.json"), length=16, per_shard=50)
    assert sorted(r.ids_crc32 for r in again.collect()) == sorted(r.ids_crc32 for r in got)
    empty = order.materialise(spark.createDataFrame([], DOCS), s.folder("none"), P.path("byte_bpe_50k.json"))
    assert not empty.collect()


def sound(freqs, rate=4000, note=0.25, noise=0.0, seed=0):
    x = np.concatenate([np.sin(2 * np.pi * f * np.arange(int(rate * note)) / rate) for f in freqs]) if len(freqs) else np.zeros(0)
    x = 0.5 * x + noise * np.random.default_rng(seed).normal(size=len(x))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_recordings_align_at_their_offset(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(chroma, "BLOCK", 100)
    tune = 440 * 2 ** (rng.integers(0, 12, 40) / 12)
    other = 440 * 2 ** (rng.integers(0, 12, 40) / 12)
    hop = chroma.HOP / 4000
    shift = 16
    late = np.concatenate([tune[int(round(shift * hop / 0.25 + 0.5)) :], other[:5]])
    rows = [(0, sound(tune)), (50, sound(tune, noise=0.02)), (1, sound(other)), (2, sound(late)), (3, None), (4, b""), (5, b"RIFFxxxx"), (6, sound([])), (7, sound(tune[:1], note=0.02)), (0, sound(tune)), (8, sound(tune)), (100, sound(np.tile(other, 30))), (9, sound(np.zeros(4000))), (150, sound(np.zeros(4000))), (None, sound(tune))]
    df = awkward(spark.createDataFrame(rows, "rec_id bigint, audio binary"))
    prints = Scratch(spark, "t").put("prints", chroma.fingerprints(df))
    table = [(r.rec_id, np.frombuffer(r.prints, "<u4").astype(np.int64)) for r in prints.collect()]

    def begins(x):
        return [i for i in range(len(x)) if not i or x[i] != x[i - 1]]

    def align(a, b):
        votes = {}
        for i in begins(a):
            for j in begins(b):
                if a[i] == b[j]:
                    votes[i - j] = votes.get(i - j, 0) + 1
        if not votes:
            return None
        o = min(votes, key=lambda o: (-votes[o], abs(o), o))
        e = chroma.bit_errors(a, b, o)
        return (round(e, 6), -votes[o], o) if votes[o] >= chroma.MIN_VOTES and e <= chroma.MAX_ERROR else None

    want = []
    least = {}
    for r, p in table:
        if len(p) and r is not None:
            least[p.tobytes()] = min(least.get(p.tobytes(), r), r)
    for i, (r, p) in enumerate(table):
        met = [(*got[:2], least[q.tobytes()], got[2]) for k, (s, q) in enumerate(table) if k != i and s is not None and s % 50 == 0 and len(q) and len(p) and (got := align(q, p))]
        top = min(met) if met else (None, None, None, None)
        want.append((r, least.get(p.tobytes()), len(met), top[2], top[3], None if top[1] is None else -top[1], top[0]))
    got = [tuple(r) for r in chroma.search(prints, F.col("rec_id") % 50 == 0).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    rows = {r[0]: r for r in got}
    assert rows[8][2] >= 3 and rows[8][3] == 0 and rows[2][4] > 0 and rows[1][3] == 100 and rows[3][1:3] == (None, 0)
    assert not chroma.search(prints.limit(0), F.col("rec_id") % 50 == 0).collect()
    assert not chroma.fingerprints(spark.createDataFrame([], "rec_id bigint, audio binary")).collect()


def test_thresholds_cover_all_values():
    r = np.random.default_rng(2).normal(size=(10_001, chroma.FILTERS))
    counts = np.stack([np.bincount(chroma.stepped(r)[:, k], minlength=chroma.STEPS) for k in range(chroma.FILTERS)])
    cuts = chroma.quartiles(counts) * 2 * chroma.SPAN / chroma.STEPS - chroma.SPAN
    assert np.abs(cuts - np.quantile(r, [0.25, 0.5, 0.75], axis=0).T).max() < 0.003


def test_integral_image_filters():
    image = np.random.default_rng(1).random((20, 12))
    r = chroma.responses(image)
    for k in range(chroma.FILTERS):
        for n in (0, 7, len(r) - 1):
            assert r[n, k] == pytest.approx(sum(s * image[n + a : n + b, c:d].sum() for a, b, c, d, s in chroma._areas(k)))
    assert chroma.packed(chroma.stepped(r), np.zeros((16, 3))).dtype == np.uint32
