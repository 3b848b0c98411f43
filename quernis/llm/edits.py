"""Which pairs of texts are within so many edits: many pairs at once, as arrays.

Counts of characters rule out many pairs, for an edit changes one count up and
one down at most. The others are stripped of what they begin and end with alike
and decided by bit vectors that slide along the diagonal (Myers' recurrence, in
Hyyro's banded form): a band of ``most + 1`` rows, in words of 64, a column
of all pairs at a time. Where few pairs have a band of one width, words set side
by side bound the edits from above (from the front to the best place and from
the back to it, words that differ being wholly rewritten); those left, and texts
of very many different characters, take the same recurrence on long integers,
pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quernis.llm.text import U64, located, text_bytes

#: Different characters of a batch up to which they are counted and tabled.
SIGNS = 400
#: Numbers in the tables of a step, by character and by column, and pairs of one band, for each word of it, that are worth one.
TABLE, COLUMNS, MANY = 1 << 21, 1 << 20, 48
#: Characters of pairs that are decided together: their codes and tables bound a task's memory.
CHARS = 1 << 21


def reached(x: str, y: str, most: int) -> bool:
    """Whether ``most`` edits are enough, by long integers as wide as the band, given up as soon as they can't be.

    ``x`` is no shorter than ``y``, longer than ``most`` and by no more than that.
    """
    at: dict[str, int] = {}
    for c in set(x):
        at[c] = int.from_bytes(np.packbits(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") == ord(c), bitorder="little").tobytes(), "little")
    n, m = len(x), len(y)
    reach = (most + n - m) // 2
    full, up, down, out, turn = (1 << (most + 1)) - 1, ((1 << (reach + 1)) - 1) << (most - reach), 0, reach, n - reach
    give_up = most + m - turn
    for j, c in enumerate(y):
        shift = j + reach - most
        same = at.get(c, 0)
        same = (same >> shift if shift >= 0 else same << -shift) & full
        across = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | (full & ~(across | up)), across & up
        if j < turn:
            out += 1 - (across >> most)
            if out > give_up:
                return False
        else:
            b = most - 1 - (j - turn)
            out += (rise >> b & 1) - (fall >> b & 1)
        moved = across >> 1
        up, down = fall | (full & ~(moved | rise)), moved & rise
    return out <= most


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """All characters as small numbers, the length of each text, and how many numbers there are."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(points.max()) + 1 if len(points) else 1, bool)
    seen[points] = True
    return (np.cumsum(seen) - 1)[points], np.array([len(t) for t in texts], np.int64), int(seen.sum())


def _banded(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, most: np.ndarray, signs: int, words: int) -> np.ndarray:
    """Whether rows of ``x`` (lengths ``n``) and ``y`` (lengths ``m``, falling) are within ``most`` edits.

    Both are padded by the number ``signs``. ``x`` is no shorter than ``y``, longer
    than ``most`` and by no more than that; ``most + 1`` rows fit in ``words`` words.
    """
    k, wide, one = len(x), signs + 1, U64(1)
    # A path that goes further down than this has to come back too far.
    reach = (most + n - m) // 2
    # Where each character stands in x, as bits, with empty words around.
    size = (x.shape[1] + 63) // 64 + 2 * words + 2
    row, place = np.nonzero(x < signs)
    bit = place + 64 * words
    spot = (row * wide + x[row, place]) * size * 2 + bit // 32
    table = np.bincount(spot, 2.0 ** (bit % 32), k * wide * size * 2).astype(np.uint32).view(U64)
    base = np.arange(k) * wide
    top = 64 * words - 1
    # The window's highest bit stands for row ``reach`` of x in the first column.
    low = top - reach
    up = [np.where(low < 64 * w + 64, ~U64(0) << np.clip(low - 64 * w, 0, 63).astype(U64), U64(0)) for w in range(words)]
    down = [np.zeros(k, U64) for _ in range(words)]
    out, turn = reach.astype(np.int64), n - reach
    # For all columns: which rows of the window are alike, and where the last row of x stands once it is in the window.
    column = np.arange(int(m[0]) if k else 0)[:, None]
    at = column + reach + 1
    index, shift = (base + y.T[: len(column)]) * size + at // 64, (at % 64).astype(U64)
    parts = [table[index + w] for w in range(words + 1)]
    rest = (U64(64) - shift) & U64(63)
    alike = [(parts[w] >> shift) | np.where(shift > 0, parts[w + 1] << rest, U64(0)) for w in range(words)]
    ahead, back = column < turn, np.clip(top - 1 - (column - turn), 0, top)
    word, by = back // 64, (back % 64).astype(U64)
    active = np.searchsorted(-m, -np.arange(len(column)), "left")
    # Along the last row, after the turn, a column makes good one edit at most.
    told, left, limit = np.zeros(k, bool), np.arange(k), most + m - turn
    for j in range(len(column)):
        a = int(active[j])
        if j % 32 == 31 and 4 * np.count_nonzero(out[:a] <= limit[:a]) < 3 * a:
            told[left] = out <= most
            stay = np.flatnonzero(out[:a] <= limit[:a])
            left, out, m, most, limit = (v[stay] for v in (left, out, m, most, limit))
            up, down = ([v[stay] for v in side] for side in (up, down))
            alike = [v[:, stay] for v in alike]
            ahead, word, by = (v[:, stay] for v in (ahead, word, by))
            a = len(stay)
            active = np.searchsorted(-m, -np.arange(len(column)), "left")
            if not a:
                return told
        if a < len(out) and a < len(up[0]):
            up, down = [v[:a] for v in up], [v[:a] for v in down]
        carry, diagonal = None, []
        for w in range(words):
            same, p = alike[w][j, :a], up[w]
            total = (same & p) + p
            if words > 1:
                over = total < p
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(U64)
            diagonal.append((total ^ p) | same | down[w])
        rise = [q | ~(d | p) for d, p, q in zip(diagonal, up, down, strict=True)]
        fall = [d & p for d, p in zip(diagonal, up, strict=True)]
        r, f = (rise[0], fall[0]) if words == 1 else (np.choose(word[j, :a], v) for v in (rise, fall))
        b = by[j, :a]
        step = ((r >> b) & one).view(np.int64) - ((f >> b) & one).view(np.int64)
        out[:a] += np.where(ahead[j, :a], 1 - (diagonal[-1] >> U64(63)).view(np.int64), step)
        for w in range(words):
            moved = diagonal[w] >> one
            if w + 1 < words:
                moved = moved | (diagonal[w + 1] << U64(63))
            up[w], down[w] = fall[w] | ~(moved | rise[w]), moved & rise[w]
    told[left] = out <= most
    return told


def _side_by_side(x: list[str], y: list[str]) -> np.ndarray:
    """No fewer edits than each pair takes, by its words."""
    k = len(x)
    data, off = text_bytes(pa.array([*x, *y], pa.string()))
    h, begin, end, doc = located(data, off, lower=False)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    size = lead[end] - lead[begin]
    n = np.bincount(doc, minlength=2 * k)
    at = np.cumsum(n) - n
    swap = n[:k] > n[k:]
    few, more = np.where(swap, at[k:], at[:k]), np.where(swap, at[:k], at[k:])
    w, extra = np.minimum(n[:k], n[k:]), np.abs(n[:k] - n[k:])
    # A slot for each word of the shorter, and one behind it.
    first = np.cumsum(w + 1) - (w + 1)
    pair = np.repeat(np.arange(k), w + 1)
    i = np.arange(len(pair)) - first[pair]
    last = i == w[pair]
    top = max(len(h) - 1, 0)
    h, size = (v if len(v) else np.zeros(1, v.dtype) for v in (h, size))
    short, front = np.minimum(few[pair] + i, top), np.minimum(more[pair] + i, top)
    back = np.minimum(front + extra[pair], top)
    costs = []
    for other in (front, back):
        cost = np.where((h[short] == h[other]) | last, 0, np.maximum(size[short], size[other]))
        total = np.cumsum(cost)
        costs.append((total - cost) - (total[first] - cost[first])[pair])
    whole = costs[1][first + w]
    letters = np.concatenate([[0], np.cumsum(size)])
    added = letters[np.minimum(more[pair] + i + extra[pair], len(size))] - letters[np.minimum(more[pair] + i, len(size))] + extra[pair]
    return np.minimum.reduceat(costs[0] + whole[pair] - costs[1] + added, first)


def _stripped(x: str, y: str) -> tuple[str, str]:
    """Both without what they begin and end with alike."""
    for turn in (1, -1):
        low, high = 0, min(len(x), len(y))
        while low < high:
            mid = (low + high + 1) // 2
            same = x[low:mid] == y[low:mid] if turn == 1 else x[len(x) - mid : len(x) - low] == y[len(y) - mid : len(y) - low]
            low, high = (mid, high) if same else (low, mid - 1)
        x, y = (x[low:], y[low:]) if turn == 1 else (x[: len(x) - low], y[: len(y) - low])
    return x, y


def within(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair, whether it takes at most ``most`` edits. Pairs of like limits go together, some ``CHARS`` characters at a time."""
    most = np.asarray(most).astype(np.int64)
    out = np.zeros(len(x), bool)
    order = np.argsort(most, kind="stable")
    total = np.cumsum([len(x[k]) + len(y[k]) for k in order])
    begin = 0
    while begin < len(order):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CHARS, "right")))
        some = order[begin:end]
        out[some] = _within([x[k] for k in some], [y[k] for k in some], most[some])
        begin = end
    return out


def _within(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    out, rest, left = np.zeros(len(x), bool), [], []
    for i in np.flatnonzero(_counted(x, y, most)):
        a, b = _stripped(x[i], y[i])
        out[i] = max(len(a), len(b)) <= most[i]
        if not out[i] and most[i] > 0:
            rest.append(i)
            left.append((a, b) if len(a) >= len(b) else (b, a))
    rest = np.array(rest, np.int64)
    words = most[rest] // 64 + 1
    for w in np.unique(words):
        some = np.flatnonzero(words == w)
        if len(some) >= MANY * w:
            out[rest[some]] = _together([left[i] for i in some], most[rest[some]], int(w))
        else:
            out[rest[some]] = _one_by_one([left[i] for i in some], most[rest[some]])
    return out


def _one_by_one(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    # Words are set apart by single blanks in normalised texts; in others a blank may cost more than is counted.
    neat = np.array([_plain(a) and _plain(b) for a, b in pairs])
    sure = np.zeros(len(pairs), bool)
    if neat.any():
        x, y = zip(*[p for p, ok in zip(pairs, neat, strict=True) if ok], strict=True)
        sure[neat] = _side_by_side(list(x), list(y)) <= most[neat]
    return np.array([bool(ok) or reached(a, b, int(n)) for (a, b), n, ok in zip(pairs, most, sure, strict=True)], bool)


def _counted(x: list[str], y: list[str], most: np.ndarray) -> np.ndarray:
    """Pairs that their counts of characters leave open."""
    k = len(x)
    code, size, signs = _codes([*x, *y])
    may = np.abs(size[:k] - size[k:]) <= most
    if signs <= SIGNS:
        of = np.repeat(np.arange(2 * k), size)
        count = np.bincount(of * signs + code, minlength=2 * k * signs).reshape(2 * k, signs)
        gap = count[:k] - count[k:]
        may &= np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)) <= most
    return may


def _plain(text: str) -> bool:
    return bool(text) and "  " not in text and text[0] != " " and text[-1] != " " and not ("\t" in text or "\n" in text or "\r" in text or "\x0b" in text or "\x0c" in text)


def _together(pairs: list[tuple[str, str]], most: np.ndarray, words: int) -> np.ndarray:
    k = len(pairs)
    code, size, signs = _codes([a for a, _ in pairs] + [b for _, b in pairs])
    if signs > SIGNS:
        return _one_by_one(pairs, most)
    at = np.cumsum(size) - size
    out = np.zeros(k, bool)
    order = np.argsort(-size[k:], kind="stable")
    begin = 0
    while begin < k:
        # Texts of like lengths at a time, so that the tables are not all padding.
        x_size, y_size = int(size[order[begin]]), int(size[k + order[begin]])
        room = max(1, min(TABLE // ((signs + 1) * ((x_size + y_size) // 64 + 2 * words + 2)), COLUMNS // ((y_size + 1) * (words + 1))))
        some = order[begin : begin + room]
        begin += len(some)
        rows = []
        for first, length in ((at[some], size[some]), (at[k + some], size[k + some])):
            place = np.arange(int(length.max()))
            rows.append(np.where(place < length[:, None], code[np.minimum(first[:, None] + place, len(code) - 1)], signs))
        out[some] = _banded(rows[0], size[some], rows[1], size[k + some], most[some], signs, words)
    return out
