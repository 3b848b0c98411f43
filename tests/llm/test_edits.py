import random
import tracemalloc

import numpy as np

from quernis.llm import edits as e


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def pairs(n, longest, stock="abc é中 "):
    rng = random.Random(longest)
    out = []
    for _ in range(n):
        a = "".join(rng.choice(stock) for _ in range(rng.randint(0, longest)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        b = "".join(b)
        if rng.random() < 0.7:
            a, b = " ".join(a.split()), " ".join(b.split())
        out.append((a, b))
    return out


def test_pairs_agree_with_a_plain_table(monkeypatch):
    for longest, many, signs in ((5, 1, 400), (63, 1, 400), (64, 100, 400), (65, 1, 400), (130, 1, 3), (300, 1, 400), (700, 1, 400)):
        monkeypatch.setattr(e, "MANY", many)
        monkeypatch.setattr(e, "SIGNS", signs)
        some = pairs(60 if longest < 700 else 12, longest) + [("", ""), ("", "abc"), ("abc", ""), ("a", "a"), ("a b c", "a x b c"), ("a b", "b a")]
        want = np.array([plain(a, b) for a, b in some])
        x, y = map(list, zip(*some, strict=True))
        for off in (-1, 0, 1, 30, 70, 150):
            assert e.within(x, y, want + off).tolist() == [off >= 0] * len(some)
    assert e.within([], [], np.zeros(0)).tolist() == []


def test_far_pairs_are_told(monkeypatch):
    """Every limit from none to more than enough, for texts that differ much."""
    monkeypatch.setattr(e, "MANY", 1)
    rng = random.Random(1)
    some = [tuple("".join(rng.choice("ab") for _ in range(rng.randint(30, 150))) for _ in "xy") for _ in range(40)]
    want = np.array([plain(a, b) for a, b in some])
    x, y = map(list, zip(*some, strict=True))
    for most in (0, 1, 5, 20, 31, 32, 33, 50, 63, 64, 65, 100, 200):
        assert e.within(x, y, np.full(40, most)).tolist() == (want <= most).tolist()


def test_memory_follows_no_number_of_pairs():
    """Twelve times the pairs take hardly more memory: a tile of a large crowd asks for very many at once."""
    rng = random.Random(5)
    x = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(50)]
    y = [a[:5] + "x" + a[6:690] + "yz" for a in x]
    peaks = []
    for times in (50, 600):
        most = np.full(50 * times, 70)
        tracemalloc.start()
        assert e.within(x * times, y * times, most).all()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0], peaks
