import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quernis.llm import lines, near_index
from quernis.llm.scratch import Scratch
from tests.llm.common import DOCS, Union, awkward, corpus, prose

SIGNS = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normalised(line):
    return SIGNS.sub(" ", line.lower()).strip()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def changed(rng, line):
    """One character replaced, or one word replaced, left out or added."""
    if rng.random() < 0.5:
        at = rng.randrange(len(line))
        return line[:at] + rng.choice("xyz") + line[at + 1 :]
    w = line.split(" ")
    at = rng.randrange(len(w))
    return " ".join(w[:at] + rng.choice([[], [prose(rng, 1)], [w[at], prose(rng, 1)]]) + w[at + 1 :])


def texts(seed=5):
    rng = random.Random(seed)
    stock = [prose(rng, rng.randint(3, 25)) for _ in range(12)] + ["Ünï cödé über Straße été naïve", "日本語の長い文章はここにあります、そして続きます。まだまだ続く"]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(stock) if rng.random() < 0.6 else prose(rng, 12)
            if rng.random() < 0.5:
                line = changed(rng, line)
            out.append(rng.choice([line, line.upper(), line + "!!", "", "ok"]))
        rows.append((i, "\n".join(out), "en", "s", 1))
    return rows + [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (None, stock[3], "en", "s", 1), (503, f"{stock[4]}\n\n\n{stock[4]}", "en", "s", 1), (504, stock[5], "en", "s", 1)]


def brute(rows, similarity=0.9, least=20):
    """The occurrences, the component of each normalised line, and what goes, by edit distance alone."""
    occ = [(d, i, n) for d, t, *_ in rows if d is not None for i, x in enumerate(t.split("\n") if t else []) if len(n := normalised(x)) >= least]
    norms, u, pairs = sorted({n for *_, n in occ}, key=len), Union(), 0
    for i, a in enumerate(norms):
        u.find(a)
        for b in norms[:i]:
            room = len(a) * (1 - similarity) + 1e-9
            if len(a) - len(b) <= room and edits(a, b) <= room:
                u.join(a, b)
                pairs += 1
    first = {}
    for d, i, n in sorted(occ):
        first.setdefault(u.find(n), (d, i))
    return occ, u, {(d, i): first[u.find(n)] for d, i, n in occ if first[u.find(n)] != (d, i)}, pairs


@pytest.mark.parametrize("each", [1, 16])
def test_against_brute_force(spark, monkeypatch, each):
    """Nothing goes that edit distance would not link; nearly all that it links is found."""
    for name, value in (("BLOCK", 8), ("SMALL", 3), ("OFTEN", 4)):
        monkeypatch.setattr(near_index, name, value)
    monkeypatch.setattr(lines, "EACH", each)
    rows = texts() + [(None if r[0] is None else 1000 + r[0], *r[1:]) for r in corpus(12)]
    df = spark.createDataFrame(rows, DOCS)
    found = Scratch(spark, "t").put("gone", lines.repeated_lines(awkward(df).drop("line")))
    occ, u, want, pairs = brute(rows)
    assert pairs > 50
    norm = {(d, i): u.find(n) for d, i, n in occ}
    got = {(r.doc_id, r.line): (r.first_doc, r.first_line) for r in found.collect()}
    assert all(k in want and norm[k] == norm[v] for k, v in got.items())
    assert len(got) >= 0.95 * len(want), (len(got), len(want))
    gone = defaultdict(list)
    for d, i in sorted(got):
        gone[d].append(i)
    for r in lines.summary(df, found).collect():
        assert r.dropped == sorted(gone.get(r.doc_id, [])) and r.n_dropped == len(r.dropped)
    monkeypatch.setattr(lines, "repeated_lines", lambda *_: found)
    kept = {r.doc_id: r.text for r in lines.without_repeats(awkward(df)).collect()}
    for d, t, *_ in (r for r in rows if r[0] is not None):
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])) if t else t
        assert (d in kept and kept[d] == left) or (gone.get(d) and not left.strip())


def test_share_of_edited_lines_found():
    """Candidates for lines of every length with one character or one word changed."""
    rng = random.Random(3)
    for n, least in ((5, 0.85), (8, 0.9), (12, 0.95), (30, 0.98), (200, 0.99)):
        old = [prose(rng, n) for _ in range(200)]
        new = [changed(rng, x) for x in old]
        both = [lines.Lines(pa.array(x)) for x in (old, new)]
        keys = [[{k[i : i + 8] for i in range(0, len(k), 8)} for k in x.keys(x.n > 0).to_pylist()] for x in both]
        assert sum(bool(a & b) for a, b in zip(*keys, strict=True)) >= least * 200


def test_very_long_lines(spark):
    """Two lines of 100,000 characters with some words changed, and one as long of other words."""
    rng = random.Random(1)
    w = prose(rng, 16_000).split(" ")
    v = list(w)
    for _ in range(300):
        v[rng.randrange(len(v))] = "other"
    rows = [(1, " ".join(w), "en", "s", 1), (2, " ".join(v), "en", "s", 1), (3, prose(rng, 16_000), "en", "s", 1)]
    assert min(len(r[1]) for r in rows) > 90_000
    got = lines.repeated_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert [(r.doc_id, r.line, r.first_doc, r.first_line) for r in got] == [(2, 0, 1, 0)]


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert not lines.repeated_lines(df).collect() and not lines.without_repeats(df).collect()
    assert not lines.summary(df, lines.repeated_lines(df)).collect()


def test_texts_of_one_id_are_told_apart(spark):
    """What goes from one text of an id stays in another."""
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 12) for _ in range(4))
    rows = [(1, a, "en", "s", 1), (5, f"{b}\n{a}", "en", "s", 1), (5, f"{c}\n{d}", "en", "s", 1)]
    got = lines.without_repeats(awkward(spark.createDataFrame(rows, DOCS)))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, a), (5, b), (5, f"{c}\n{d}")])


def test_a_pair_of_many_crowds_is_compared_in_one():
    """Of the keys that two lines share only the least has them compared; lengths too far apart have them compared nowhere."""
    none = 2**63 - 1
    rows = np.full((4, 1 + lines.KEYS), none)
    for k, (n, *keys) in enumerate([(100, -7, 5, 9), (95, -7, 4, 5), (100, 4, 5, 9), (50, -7, 4, 5)]):
        rows[k, : 1 + len(keys)] = (n, *keys)
    sig = np.ascontiguousarray(rows.astype(">i8")).view(np.uint8).reshape(4, -1)
    met = {key: {(i, j) for i, j in zip(*np.nonzero(lines._likely(key, sig, sig, 0.9)), strict=True) if i < j} for key in (-7, 4, 5, 9)}
    assert (0, 1) in met[-7] and (0, 1) not in met[5]
    assert (1, 2) in met[4] and (1, 2) not in met[5]
    assert (0, 2) in met[5] and (0, 2) not in met[9]
    assert not any(3 in pair for pairs in met.values() for pair in pairs)


def test_keys_are_moved_in_few_bytes():
    """Keys come back as they were sent, also where steps are wide, and cost four or five bytes each."""
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 48, 200_000)
    keys[:50] = keys[50:100]
    nodes, sizes = rng.integers(-(2**63), 2**63 - 1, len(keys)), np.full(len(keys), 9, np.uint16)
    cells = [r for b in near_index._packed(keys, nodes, sizes, 8, 64, True) for r in b.to_pylist()]
    back = np.concatenate([near_index._from_steps(r["keys"], len(r["nodes"]) // 8) for r in cells])
    of = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in cells])
    assert sorted(zip(back.tolist(), of.tolist(), strict=True)) == sorted(zip(keys.tolist(), nodes.tolist(), strict=True))
    assert sum(len(r["keys"]) for r in cells) < 5.1 * len(keys)
    for some in ([], [3], [3, 3], [0, (1 << 47)], [1, 2, 1 << 40]):
        some = np.array(some, np.int64)
        assert near_index._from_steps(near_index._steps(some), len(some)).tolist() == some.tolist()


def test_components_of_many_tiles_are_connected_once():
    """Links of one tile spare the pairs of the next; whatever is linked is connected."""
    asked = []

    def alike(x, y):
        asked.append(len(x))
        return np.array([a[0] == b[0] for a, b in zip(x, y, strict=True)], bool)

    forest, links = near_index._Forest(alike), []
    for _ in range(3):
        at = forest.hold([1, 2, 3, 4], [1, 2, 3, 4], ["a1", "a2", "a3", "b4"])
        i, j = np.triu_indices(4, 1)
        apart = forest.apart(at[i], at[j])
        for b in forest.add(at[i][apart], at[j][apart]):
            links += b.to_pylist()
        for b in forest.rest(0, 0):
            links += b.to_pylist()
    union = Union()
    for r in links:
        union.join(r["a"], r["b"])
    assert len(links) == 2 and len({union.find(k) for k in (1, 2, 3)}) == 1 and union.find(4) != union.find(1)
    assert asked[0] == 6 and sum(asked[1:]) <= 6
