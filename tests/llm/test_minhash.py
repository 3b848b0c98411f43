import random

import numpy as np
import pyarrow as pa
import pytest

from quernis.llm import minhash, near_index
from tests.llm.common import DOCS, Union, awkward, corpus, prose, shingle_set


def brute(rows, n, percent=80):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault((r[0], r[1]), shingle_set(r[1], n))
    u, items = Union(), list(sets.items())
    for i, ((a, _), x) in enumerate(items):
        u.find(a)
        for (b, _), y in items[:i]:
            if x and y and a != b and 100 * len(x & y) >= percent * len(x | y):
                u.join(a, b)
    return sorted(((d, len(shingle_set(t, n)), None if d is None else u.find(d), d is None or u.find(d) == d) for d, t, *_ in rows), key=str)


def group(n=110, seed=8):
    """Near copies of one text, many of them linked by chains only."""
    rng = random.Random(seed)
    base = prose(rng, 90).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((10_000 + i, " ".join(w), "en", "a", 1))
    return rows


@pytest.mark.parametrize("each", [1, 16])
def test_against_brute_force(spark, monkeypatch, each):
    """Odd rows and a large group, with all rounds and several blocks in use."""
    for name, value in (("BLOCK", 16), ("SMALL", 4), ("OFTEN", 8)):
        monkeypatch.setattr(near_index, name, value)
    monkeypatch.setattr(minhash, "EACH", each)
    rows = corpus(11) + group()
    got = minhash.near_duplicates(awkward(spark.createDataFrame(rows, DOCS)), how=minhash.Shingling(2, 80)).drop("of")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_empty_table(spark):
    got = minhash.near_duplicates(spark.createDataFrame([], DOCS))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept", "of"] and not got.collect()
    one = minhash.near_duplicates(spark.createDataFrame([(1, None, None, None, None)], DOCS)).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 0, 1, True)]


def test_masked_keys_keep_the_pigeonhole_promise():
    """Signatures that differ in at most 2 * CHUNKS - 1 symbols share a key, and the first they share is the one to compare on."""
    rng = np.random.default_rng(4)
    m = minhash.CHUNKS * minhash.WIDTH
    a = rng.integers(0, 256, (60, m)).astype(np.uint8)
    b = a.copy()
    for k in range(60):
        at = rng.choice(m, 2 * minhash.CHUNKS - 1, replace=False)
        b[k, at] = (b[k, at].astype(int) + 1) % 256
    pack = lambda x: [r.tobytes() + np.array([9], "<u4").tobytes() for r in x]
    keys = [minhash.masked_keys(pa.array(pack(x), pa.binary()))[0].reshape(60, m) for x in (a, b)]
    as_rows = [np.frombuffer(b"".join(pack(x)), np.uint8).reshape(60, minhash.SIG) for x in (a, b)]
    for k in range(60):
        common = sorted(set(keys[0][k]) & set(keys[1][k]))
        assert common
        hits = [c for c in common if minhash.likely(int(c), as_rows[0][k : k + 1], as_rows[1][k : k + 1], 80)[0, 0]]
        assert hits == common[:1]


def test_another_text_of_a_dropped_id_stays(spark):
    """A row goes by its id and text; other columns, whatever their names, come through."""
    rng = random.Random(2)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (6, c, "en", "s", 1), (6, c, "en", "s", 2), (None, a, "en", "s", 1), (7, None, None, None, None)]
    df = awkward(spark.createDataFrame(rows, DOCS))
    got = minhash.without_copies(df)
    assert got.columns == df.columns
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == sorted([r for r in rows if r != rows[1]], key=str)
    assert not minhash.without_copies(df.limit(0)).collect()
