import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quernis.llm import langid
from tests.llm.common import DOCS, awkward, corpus, prose

STOCK = {"en": "the of and tion ing er on", "de": "der die und ung keit sch ein", "fr": "le les et eau oui ment aux", "es": "el los que ción ado mente ña"}


def labelled(n=60, seed=1, langs=tuple(STOCK)):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(5, 60), STOCK[(v := langs[i % len(langs)])]), v, "s", 1) for i in range(n)]


def test_held_out_accuracy_and_odd_texts(spark):
    docs = spark.createDataFrame(labelled(200), DOCS)
    model = langid.fit(docs.where(~langid.held_out()))
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(out[d].lang_pred == v and 0 <= out[d].score <= 1 for d, _, v, *_ in labelled(200))
    odd = langid.predict(awkward(spark.createDataFrame(corpus(3), DOCS)), model, keep=("doc_id", "text", "a.b", "k")).collect()
    assert len(odd) == len(corpus(3))
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in {*STOCK, "und"} and 0 <= r.score <= 1
    assert not langid.predict(spark.createDataFrame([], DOCS), model).collect()


def test_nothing_or_one_language_to_learn(spark):
    docs = spark.createDataFrame(labelled(8), DOCS)
    none = langid.fit(spark.createDataFrame([(1, "x", None, "s", 1), (2, None, "en", "s", 1)], DOCS))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"fr"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    c = langid.codewords(n)
    far = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
    assert far >= (2 ** (n - 2) if n <= langid.EXHAUSTIVE else c.shape[1] // 5)
    assert (abs(c.sum(axis=0)) < n).all()


def test_a_mixture_is_flagged(spark):
    model = langid.fit(spark.createDataFrame(labelled(80, langs=("en", "de")), DOCS))
    en, de = labelled(2, langs=("en", "de"))
    scores = {r.doc_id: r.score for r in langid.predict(spark.createDataFrame([(1, en[1], None, "s", 1), (2, f"{en[1]} " * 20 + f"{de[1]} " * 20, None, "s", 1)], DOCS), model).collect()}
    assert scores[2] < scores[1]


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array([r[1] for r in corpus(7)], pa.string())
    w = np.random.default_rng(1).integers(-9, 9, (3, langid.BUCKETS)).astype(np.int32)
    whole = langid.sums(texts, w)
    monkeypatch.setattr(langid, "PIECE", 53)
    assert (whole == langid.sums(texts, w)).all()
    one = [langid.sums(pa.array([t], pa.string()), w)[0] for t in texts.to_pylist()]
    assert (whole == np.array(one)).all()


def plain_buckets(text):
    """The bucket of the trigram around each letter, one byte at a time."""
    kind = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    out = []
    for before, mid, after in zip([32, *kind], kind, [*kind[1:], 32], strict=False):
        if mid != 32:
            h = (before * 0x9E3779B1 % 2**32) ^ (mid * 0x85EBCA77 % 2**32) ^ (after * 0xC2B2AE3D % 2**32)
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> 17) % (langid.BUCKETS - 1) + 1)
    return out


def plain_codes(train, texts):
    """Every step of the method with dictionaries: counts, splits, bit classifiers, loss-weighted decoding."""
    langs = sorted({v for _, v in train})
    counts = {v: Counter(b for t, w in train if w == v for b in plain_buckets(t)) for v in langs}
    total = {v: sum(counts[v].values()) + 0.5 * (langid.BUCKETS - 1) for v in langs}
    p = {v: (lambda b, v=v: (counts[v][b] + 0.5) / total[v]) for v in langs}
    splits = [{v: 1 if k == 0 or not (s >> (k - 1)) & 1 else -1 for k, v in enumerate(langs)} for s in range(1, 2 ** (len(langs) - 1))]

    def weight(split, b):
        yes, no = ([p[v](b) for v in langs if split[v] == side] for side in (1, -1))
        return round(max(-4, min(4, math.log((sum(yes) / len(yes) + 1e-9) / (sum(no) / len(no) + 1e-9)))) * langid.UNIT) / langid.UNIT

    known = sorted({b for c in counts.values() for b in c})
    unknown = {v: 1 - sum(p[v](b) for b in known) for v in langs}
    rare = next(b for b in range(1, langid.BUCKETS) if b not in set(known))
    weights = [{b: weight(s, b) for b in known} for s in splits]
    expected = [{v: sum(p[v](b) * w[b] for b in known) + unknown[v] * weight(s, rare) for v in langs} for s, w in zip(splits, weights, strict=True)]
    out = []
    for text in texts:
        found = plain_buckets(text)
        loss = {}
        for v in langs:
            trust = [max(e[v] * s[v], 1e-9) for e, s in zip(expected, splits, strict=True)]
            loss[v] = 0
            for s, w, e, q in zip(splits, weights, expected, trust, strict=True):
                margin = sum(w[b] if b in w else weight(s, rare) for b in found) / max(len(found), 1)
                loss[v] += q / sum(trust) * math.log1p(math.exp(-4 * margin * s[v] / max(abs(e[v]), 1e-9)))
        best, second = sorted(loss.values())[:2]
        out.append((min(langs, key=loss.get), 1 - best / second))
    return out


def test_against_a_plain_version(spark):
    """Predictions and scores of learned, unlearned, mixed and odd texts."""
    rows = labelled(40, seed=7)
    rng = random.Random(8)
    mixed = [" ".join(prose(rng, 6, STOCK[v]) for v in rng.sample(list(STOCK), 2)) for _ in range(30)]
    odd = ["x", "Ünï 12 cödé!", "zzz qqq", "a" * 500, "der the le los"]
    texts = [r[1] for r in rows[:20]] + mixed + odd
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    want = plain_codes([(r[1], r[2]) for r in rows], texts)
    for r, (lang, score) in zip(got, want, strict=True):
        assert r.score == pytest.approx(score, abs=1e-6) and r.ambiguous == (r.score < langid.AMBIGUOUS)
        assert r.lang_pred == lang or score < 1e-6
    assert any(r.ambiguous for r in got) and not all(r.ambiguous for r in got)


def test_many_languages_have_codewords_of_their_own():
    c = langid.codewords(260)
    assert len(np.unique(c, axis=0)) == 260
