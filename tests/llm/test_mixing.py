from collections import defaultdict

import pytest

from quernis.llm import mixing
from tests.llm.common import DOCS, awkward, corpus, words


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by turns: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return goal | {s: left * w[s] / total for s in open_}
        for s in over:
            goal[s] = cap * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(goal.values())
    return goal


def test_against_plain_water_filling(spark):
    rows = corpus(21)
    got = mixing.copies(awkward(spark.createDataFrame(rows, DOCS)).drop("size", "copies")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(dict(sizes))
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1) and r.copies <= 3
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 1000}, {"a": 10}, {"a": 0, "b": 5}, {"b": 1, "a": 1, "c": 1, "d": 900, None: 3}, {"x": 0}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")).collect()}
    assert got == pytest.approx(targets(sizes))


def test_reruns_agree_and_mixed_repeats(spark):
    docs = spark.createDataFrame(corpus(22), DOCS)
    a, b = (sorted(map(tuple, mixing.copies(docs.repartition(n)).collect()), key=str) for n in (1, 7))
    assert a == b
    mixed = mixing.mixed(awkward(docs))
    assert mixed.columns == awkward(docs).columns
    assert mixed.count() == sum(r[-1] for r in a)
    assert not mixing.copies(spark.createDataFrame([], DOCS)).collect() and not mixing.mixed(spark.createDataFrame([], DOCS)).collect()


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), None, "ab"[i % 10 == 0], 1) for i in range(20_000)]
    taken, goal = defaultdict(int), {}
    for r in mixing.copies(spark.createDataFrame(rows, DOCS)).collect():
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) < 0.05 * goal[s] for s in goal)
