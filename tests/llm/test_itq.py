import numpy as np
import pytest

from quernis.llm import itq
from tests.llm.common import Union

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(d=16, seed=2):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None, 2):
        base = rng.normal(size=(40, d))
        for k, b in enumerate(base):
            for _ in range(1 if k % 3 else 4):
                rows.append((i, (b + rng.normal(size=d) * rng.choice([0, 0.02, 0.1, 0.2])).astype(np.float32).tolist(), label))
                i += 1
    hub = rng.normal(size=d)
    rows += [(i + k, (hub + rng.normal(size=d) * 0.14).astype(np.float32).tolist(), 1) for k in range(120)]
    i += 200
    odd = [None, [], [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0], [1.0] * (d + 1)]
    rows += [(i + k, v, 1) for k, v in enumerate(odd)]
    rows += [rows[0], (None, rows[5][1], rows[5][2])]
    return rows


def brute(rows, threshold=0.98):
    unit = []
    for _, v, label in rows:
        ok = v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    u, links = Union(), [0] * len(rows)
    for a in range(len(rows)):
        u.find(a)
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                u.join(a, b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            root = u.find(k)
            least[root] = min(least.get(root, r[0]), r[0])
    comp = [least.get(u.find(k)) for k in range(len(rows))]
    return sorted(((r[0], links[k], comp[k], comp[k] is None or r[0] is None or comp[k] == r[0]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("d", "block", "narrow"), [(64, 8, 8), (64, 8, 0), (3, 4096, 8)])
def test_against_brute_force(spark, monkeypatch, d, block, narrow):
    """Blocks of a few vectors; two tables and four; equal vectors, odd ones and a hub."""
    monkeypatch.setattr(itq, "BLOCK", block)
    monkeypatch.setattr(itq, "NARROW", narrow)
    rows = vectors(d)
    got = sorted(map(tuple, itq.near_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as v", "3 as part", "4 as n_links")).collect()), key=str)
    want = brute(rows)
    # A null id has no identity of its own; all else is compared.
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None] and len(got) == len(want)


def test_empty(spark):
    assert not itq.near_vectors(spark.createDataFrame([], SCHEMA)).collect()
    assert [tuple(r) for r in itq.near_vectors(spark.createDataFrame([(5, None, 1)], SCHEMA)).collect()] == [(5, 0, 5, True)]


def test_the_rotation_is_orthonormal_and_balances():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 12)) * np.linspace(3, 0.2, 12)
    x /= np.linalg.norm(x, axis=1)[:, None]
    r = itq.learn_rotation(x, 12)
    assert np.allclose(r.T @ r, np.eye(12))
    plain = np.linalg.eigh(x.T @ x)[1]
    gap = lambda t: ((np.sign(x @ t) / np.sqrt(12) - x @ t) ** 2).sum()
    assert gap(r) < gap(plain) and (np.abs(((x @ r) > 0).mean(axis=0) - 0.5) < 0.1).all()


def test_all_near_pairs_meet():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    y = x + rng.normal(size=x.shape) * 0.19
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    near = (x * y).sum(axis=1) >= 0.98
    for tables in (itq.FEW_TABLES, itq.TABLES):
        index = itq.Index(itq.learn_rotation(x, 64), x, 8, 0.98, tables)
        met = index.first_meeting(index.turned(x), index.turned(y)) < 2 * tables
        assert met[near].all() and near.sum() > 500
