"""Components of items that share index keys, without listing the pairs of a crowd.

Items share many keys with their near copies. Three steps find every link:

1. *Sharing.* Keys are dealt to tasks by hash, packed as plain numbers, and the
   groups of equal keys are found there. A key of 2 to ``SMALL`` items gives its
   pairs whose sizes allow a link; a larger one is a *crowd* and gives one row for each member. A key
   that is frequent in one stretch of the input is known for a crowd there and
   its members are spread, so no task holds a hot key.
2. *Hubs.* Each member of a crowd is verified against one member of the crowds
   it belongs to, beside the pairs. Most of a group of copies becomes one
   component at once, and a crowd within one component needs nothing more.
3. *Tiles.* The members of crowds left open are dealt to blocks, and every two
   blocks of a crowd meet in a task of their own, first by their short
   signatures. Where few pairs of other components are likely, at most ``each``
   for a member, these are listed, and a pair that meets in many crowds is
   verified once. Where there are more, the members meet again by what decides,
   and only a spanning forest of their links leaves the task.

So a pair that shares a key is left out only if both are in one component
already, or their signatures rule it out.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernis.llm.graph import components
from quernis.llm.scratch import Scratch
from quernis.llm.text import U64, mix, release

#: Items of one key whose pairs are listed; a key of more is a crowd.
SMALL = 4
#: Keys that a task packs at once, and how often one of them may occur among these before it is known for a crowd.
STRETCH, OFTEN = 1 << 20, 64
#: Bytes of packed keys in one task, and members and bytes of what decides in one block of a crowd.
PART, BLOCK, BLOCK_BYTES = 24 << 20, 4096, 32 << 20
#: Likely pairs that are compared together, and characters of what decides that a task holds for them.
PAIRS, HELD = 50_000, 16 << 20


@dataclass
class Rules:
    """What tells links from other pairs.

    ``verify(pairs)`` takes ``(a, b)`` and keeps the linked ones.
    ``likely(key, x, y)`` takes signatures as matrices of bytes and gives a
    matrix: which rows of ``x`` and ``y`` should be compared on this key.
    ``payload(nodes)`` gives ``(node, payload)`` of what decides, for ``nodes(node)``
    at least, and ``tile(x, y)`` takes two lists of ``(node, label,
    payload)``, the same one twice for the pairs of one block, and gives links
    that connect whatever is linked between them, beyond what the labels connect.
    Instead of it ``alike(x, y)`` may take payloads side by side and tell which
    pairs are linked: then the likely pairs of many tiles are compared together.
    """

    verify: Callable[[DataFrame], DataFrame]
    likely: Callable[[int, np.ndarray, np.ndarray], np.ndarray]
    payload: Callable[[DataFrame], DataFrame]
    tile: Callable[[list, list], Iterator[tuple[int, int]]] | None = None
    alike: Callable[[list, list], np.ndarray] | None = None
    #: How often members meet a hub before they meet in tiles, and likely pairs for a member that are listed; both only save work.
    hubs: int = 2
    each: int = 16


def _grouped(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(key, node)`` of keys that occur twice or more, in order, with their sizes, and where each key begins (with the end)."""
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
    keys, order = keys[twice], order[twice]
    nodes, sizes = nodes[order], sizes[order]
    order = np.lexsort((nodes, keys))
    keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, sizes = keys[new], nodes[new], sizes[new]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys, nodes, sizes, np.append(begin, len(keys))


_PACKED = "part int, kind int, keys binary, nodes binary, sizes binary"
_COLD, _CROWD, _KNOWN = 0, 1, 2


def dealt_out(part: np.ndarray, kind: int, columns: list[np.ndarray], first: Callable[[np.ndarray], bytes] = np.ndarray.tobytes):
    """One row for each part, with the columns' numbers as bytes, those of the first as ``first`` gives them."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint16) if int(part.max()) < 1 << 16 else part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    cells = [[(a[s:e].tobytes() if c else first(a[s:e])) for s, e in zip(cut, cut[1:], strict=False)] for c, a in enumerate(columns)]
    rows = [pa.array(part[cut[:-1]]), pa.array(np.full(len(cut) - 1, kind, np.int32)), *[pa.array(c, pa.binary()) for c in cells]]
    yield pa.RecordBatch.from_arrays(rows, ["part", "kind", "keys", "nodes", "sizes"][: len(rows)])


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix(x.astype(U64)) % U64(parts)).astype(np.int32)


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of numbers of 48 bits: each has a range of them."""
    return (((keys >> 24) * parts) >> 24).astype(np.int32)


def _steps(keys: np.ndarray) -> bytes:
    """Ordered keys as the first and the steps to the next, each in as many bytes as the widest needs."""
    step = np.diff(keys)
    wide = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return keys[:1].tobytes() + step.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _from_steps(cell: bytes, n: int) -> np.ndarray:
    out, first = np.zeros((n, 8), np.uint8), min(n, 1)
    if n > 1:
        wide = (len(cell) - 8) // (n - 1)
        out[1:, :wide] = np.frombuffer(cell, np.uint8, offset=8).reshape(n - 1, wide)
    out[:first] = np.frombuffer(cell, np.uint8, 8 * first).reshape(first, 8)
    return np.cumsum(out.ravel().view("<i8"))


def _packed(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, parts: int, often: int, hashed: bool):
    """Rows of each part and kind: keys that may be shared, members of known crowds, and what is known for one."""
    at, cell = (_range_of, _steps) if hashed else (part_of, np.ndarray.tobytes)
    if hashed:
        order = np.argsort(keys)
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
    sorted_keys = keys if hashed else np.sort(keys)
    known = np.unique(sorted_keys[often:][sorted_keys[often:] == sorted_keys[:-often]]) if len(keys) > often else keys[:0]
    if len(known):
        hot = np.isin(keys, known)
        yield from dealt_out(part_of(keys[hot] ^ mix(nodes[hot].astype(U64)).view(np.int64), parts), _CROWD, [keys[hot], nodes[hot], sizes[hot]])
        yield from dealt_out(at(known, parts), _KNOWN, [known, known, np.zeros(len(known), np.uint16)])
        keys, nodes, sizes = keys[~hot], nodes[~hot], sizes[~hot]
    yield from dealt_out(at(keys, parts), _COLD, [keys, nodes, sizes], cell)


def repeated(scratch: Scratch, numbers: DataFrame, rows: int) -> DataFrame:
    """``(node)``: the numbers of the one column that occur more than once among some ``rows``."""
    parts = max(1, -(-rows * 16 // PART))
    stretch = STRETCH

    def deal(batches):
        held, size = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b.column(0).to_numpy())
                size += b.num_rows
            if held and (b is None or size > stretch):
                x, n = np.unique(np.concatenate(held), return_counts=True)
                yield from dealt_out(part_of(x, parts), 0, [x, np.minimum(n, 2)])
                held, size = [], 0

    def meet(batches):
        got = [(k, n) for b in batches for k, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if got:
            x, of = np.unique(_numbers([k for k, _ in got]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(x[np.bincount(of, _numbers([n for _, n in got])) > 1])], ["node"])

    dealt = numbers.mapInArrow(deal, "part int, kind int, keys binary, nodes binary").repartitionById(int(parts), F.col("part"))
    return scratch.put("repeated", dealt.mapInArrow(meet, "node bigint"))


def _numbers(cells: list[bytes], kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind)


def sharing(scratch: Scratch, keyed: DataFrame, keys_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], total: int, percent: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` and crowds ``(key, node)`` of ``keyed(node, what, size)`` with ``total`` keys; a node may stand on many rows.

    ``keys_of`` gives the keys of a batch of ``what``, and how many each row has.
    A pair whose lesser size is below ``percent`` of the greater is left out. Of
    ``hashed`` keys, any 64 bits alike often, the upper 48 are used and moved in four or five bytes.
    """
    parts = max(1, -(-total * 16 // PART))
    small, often, stretch = SMALL, OFTEN, STRETCH

    def deal(batches):
        held, size = [], 0
        for b in batches:
            keys, n = keys_of(b.column(1))
            keys = (keys.view(U64) >> U64(16)).view(np.int64) if hashed else keys
            # Beyond 16 bits sizes count as equal, which leaves out fewer pairs.
            short = np.minimum(b.column(2).to_numpy(), 65_535).astype(np.uint16)
            held.append((keys, np.repeat(b.column(0).to_numpy(), n), np.repeat(short, n)))
            size += int(n.sum())
            if size > stretch:
                yield from _packed(*map(np.concatenate, zip(*held, strict=True)), parts, often, hashed)
                held, size = [], 0
        if size:
            yield from _packed(*map(np.concatenate, zip(*held, strict=True)), parts, often, hashed)

    def meet(batches):
        cold: list[tuple[bytes, bytes, bytes]] = []
        known: list[bytes] = []
        for b in batches:
            for kind, k, v, z in zip(*[b.column(c).to_pylist() for c in range(1, 5)], strict=True):
                if kind == _CROWD:
                    yield _members(np.frombuffer(k, np.int64), np.frombuffer(v, np.int64))
                elif kind == _KNOWN:
                    known.append(k)
                else:
                    cold.append((k, v, z))
        k, v, z = zip(*cold, strict=True) if cold else ([], [], [])
        k = np.concatenate([_from_steps(c, len(of) // 8) for c, of in zip(k, v, strict=True)]) if hashed and cold else _numbers(k)
        keys, nodes, sizes, at = _grouped(k, _numbers(v), _numbers(z, np.uint16))
        n = np.diff(at)
        crowd = n > small
        if known and len(n):
            crowd |= np.isin(keys[at[:-1]], np.unique(_numbers(known)))
        if known and len(k):
            # Of a key known for a crowd a part may hold one member only.
            every, lone = k, np.unique(_numbers(known))
            lone = np.isin(every, lone) & ~np.isin(every, keys[at[:-1]])
            yield _members(every[lone], _numbers(v)[lone])
        member = np.repeat(crowd, n)
        for s in range(0, int(member.sum()), 1 << 17):
            some = np.flatnonzero(member)[s : s + (1 << 17)]
            yield _members(keys[some], nodes[some])
        end = np.repeat(np.where(crowd, 0, at[1:]), n)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, small):
            i = np.flatnonzero(np.arange(len(keys)) + d < end)
            if not len(i):
                break
            x, y = sizes[i].astype(np.int64), sizes[i + d].astype(np.int64)
            i = i[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
            a.append(nodes[i])
            b.append(nodes[i + d])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        for s in range(0, len(a), 1 << 17):
            yield _rows(None, a[s : s + (1 << 17)], b[s : s + (1 << 17)])
        del keys, nodes, sizes, a, b
        release()

    dealt = keyed.mapInArrow(deal, _PACKED).repartitionById(int(parts), F.col("part"))
    found = scratch.put("shared", dealt.mapInArrow(meet, "key bigint, a bigint, b bigint"))
    return found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("node"))


def _rows(key, a, b) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b)], ["key", "a", "b"])


def _members(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    return _rows(keys, nodes, None)


def linked_components(scratch: Scratch, pairs: DataFrame, crowd: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """``(node, label)`` of every node that has a link; the label is its component's least node.

    ``pairs`` and ``crowd`` come from ``sharing``. ``items(node, sig, bytes)``
    has one row for each node: its signature and how many bytes of what decides
    it has.
    """
    crowded = crowd.limit(1).count() > 0
    labels = None
    for turn in range(rules.hubs if crowded else 1):
        todo = pairs if not turn else None
        if crowded:
            at = _labelled(crowd, labels)
            rank = F.xxhash64(F.lit(turn), "node")
            open_ = at.groupBy("key").agg(F.min_by(F.struct("node", "label"), rank).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
            met = at.join(open_.select("key", "hub"), "key").where("label <> hub.label").groupBy("node").agg(F.min_by("hub.node", F.xxhash64(F.lit(turn), "hub.node")).alias("hub"))
            hubs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            todo = hubs if todo is None else todo.union(hubs)
        todo = scratch.put("pairs", todo.distinct())
        labels = _joined(scratch, labels, scratch.put("links", rules.verify(todo)))
        scratch.drop(todo)
    if crowded:
        labels = _joined(scratch, labels, scratch.put("links", _tiled(scratch, _labelled(crowd, labels), items, rules)))
    return labels


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").select(*rows.columns, F.coalesce("label", "node").alias("label"))


def _joined(scratch: Scratch, labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels with the links ``found(a, b)`` counted in: what is one component already is one node of theirs."""
    if labels is None:
        return components(scratch, found)
    ends = found
    for c in "ab":
        of = labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        ends = ends.join(of, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    between = scratch.put("between", ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct())
    if not between.limit(1).count():
        return labels
    merged = components(scratch, between)
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = scratch.put("labels", old.union(merged.join(labels, "node", "left_anti").select("node", "label")))
    scratch.drop(found, between, merged, labels)
    return new


def _tiled(scratch: Scratch, at: DataFrame, items: DataFrame, rules: Rules) -> DataFrame:
    """Links ``(a, b)`` between the components of each crowd."""
    likely_of, tile_of, alike, each = rules.likely, rules.tile, rules.alike, rules.each
    at = scratch.put("members", at.join(items, "node"))
    stats = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    stats = scratch.put("open", stats.select("key", blocks.alias("blocks")))
    at = at.join(stats, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiles = at.select(F.xxhash64("key", low, high).alias("tile"), "key", (F.col("block") == low).alias("first"), (low == high).alias("own"), "node", "label", "sig")
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")

    names = ["tile", "first", "own", "node", "label", "other", "key", "sig"]
    kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def sift(batches):
        held, many = [], 0
        for cells in _sifted(batches):
            held.append([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)])
            many += len(cells[0])
            if many > 10_000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)
                held, many = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)

    def _sifted(batches):
        for tile, rows in _each_tile(batches):
            first, own, node, label = (np.array(c) for c in rows[2:6])
            sig = np.frombuffer(b"".join(rows[6]), np.uint8).reshape(len(node), -1)
            x = np.flatnonzero(first)
            y = x if own[0] else np.flatnonzero(~first)
            wanted, pairs, n = np.zeros(len(node), bool), [], 0
            for s in range(0, len(x), 64):
                some = x[s : s + 64]
                hit = label[some][:, None] != label[y][None]
                if own[0]:
                    hit &= some[:, None] < y[None]
                if not hit.any():
                    continue
                hit &= likely_of(int(rows[1][0]), sig[some], sig[y])
                wanted[some] |= hit.any(axis=1)
                wanted[y] |= hit.any(axis=0)
                n += int(hit.sum()) * (1 + own[0])
                if n <= each * len(node):
                    i, j = np.nonzero(hit)
                    pairs.append((node[some[i]], node[y[j]]))
            i = np.flatnonzero(wanted)
            if n > each * len(node):
                cells = [np.full(len(i), tile), first[i], np.full(len(i), own[0]), node[i], label[i], np.full(len(i), None), [rows[1][0]] * len(i), [rows[6][k] for k in i]]
            elif n:
                a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
                none = np.full(len(a), None)
                cells = [none, none, none, np.minimum(a, b), none, np.maximum(a, b), none, none]
            else:
                continue
            yield cells

    found = scratch.put("likely", dealt.mapInArrow(sift, "tile bigint, first boolean, own boolean, node bigint, label bigint, other bigint, key bigint, sig binary"))
    pairs = scratch.put("pairs", found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    links = rules.verify(pairs)
    likely = found.where("other is null").drop("other")
    if not likely.limit(1).count():
        return links
    said = [] if alike is None else ["key", "sig"]
    full = likely.join(rules.payload(likely.select("node").distinct()), "node").select("tile", "first", "own", "node", "label", "payload", *said).repartition("tile").sortWithinPartitions("tile")

    def decide(batches):
        for _, (_, first, own, *rows) in _each_tile(batches):
            x = [r for r, f in zip(zip(*rows, strict=True), first, strict=True) if f]
            y = x if own[0] else [r for r, f in zip(zip(*rows, strict=True), first, strict=True) if not f]
            out = list(tile_of(x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        release()

    def connect(batches):
        forest = _Forest(alike)
        for _, (_, first, own, node, label, payload, key, sig) in _each_tile(batches):
            at = forest.hold(node, label, payload)
            sigs = np.frombuffer(b"".join(sig), np.uint8).reshape(len(at), -1)
            first = np.array(first)
            x = np.flatnonzero(first)
            y = x if own[0] else np.flatnonzero(~first)
            for s in range(0, len(x), 64):
                some = x[s : s + 64]
                hit = forest.apart(at[some][:, None], at[y][None])
                if own[0]:
                    hit &= some[:, None] < y[None]
                if hit.any():
                    hit &= likely_of(int(key[0]), sigs[some], sigs[y])
                    i, j = np.nonzero(hit)
                    yield from forest.add(at[some[i]], at[y[j]])
            yield from forest.rest(PAIRS, HELD)
        yield from forest.rest(0, 0)
        release()

    return links.union(full.mapInArrow(decide if alike is None else connect, "a bigint, b bigint"))


class _Forest:
    """Links that connect whatever is linked among pairs and not yet connected, of many tiles together.

    Of each two components a few pairs are compared, then more: a link spares the rest.
    """

    def __init__(self, alike: Callable[[list, list], np.ndarray]):
        self.alike = alike
        self.name: dict[int, int] = {}
        self.root = np.zeros(0, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.node, self.of, self.payload, self.size, self.pairs, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, [], 0

    def hold(self, node: list, label: list, payload: list) -> np.ndarray:
        """Takes the members of a tile and gives their places."""
        of = np.array([self.name.setdefault(v, len(self.name)) for v in label], np.int64)
        self.root = np.append(self.root, np.arange(len(self.root), len(self.name)))
        at = np.arange(len(self.node), len(self.node) + len(node))
        self.node, self.of = np.append(self.node, np.array(node, np.int64)), np.append(self.of, of)
        self.payload += payload
        self.size += sum(map(len, payload))
        return at

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.root[self.of[x]] != self.root[self.of[y]]

    def add(self, x: np.ndarray, y: np.ndarray):
        self.pairs.append((x, y))
        self.n += len(x)
        if self.n > PAIRS:
            yield from self._compared()

    def rest(self, pairs: int, size: int):
        """Compares what is left and lets members go, if there is more than that."""
        if self.n > pairs or self.size > size:
            yield from self._compared()
            self._clear()

    def _compared(self):
        if not self.n:
            return
        x, y = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        self.pairs, self.n, some = [], 0, 4
        while len(x):
            apart = self.apart(x, y)
            x, y = x[apart], y[apart]
            a, b = self.root[self.of[x]], self.root[self.of[y]]
            both = np.minimum(a, b) * len(self.root) + np.maximum(a, b)
            order = np.argsort(both, kind="stable")
            rank = np.empty(len(both), np.int64)
            rank[order] = np.arange(len(both)) - np.searchsorted(both[order], both[order])
            now = np.flatnonzero(rank < some)
            told = self.alike([self.payload[v] for v in x[now]], [self.payload[v] for v in y[now]])
            links = []
            for k in now[told]:
                a, b = (self._top(self.of[v]) for v in (x[k], y[k]))
                if a != b:
                    links.append((self.node[x[k]], self.node[y[k]]))
                    self.root[max(a, b)] = min(a, b)
            while ((further := self.root[self.root]) != self.root).any():
                self.root = further
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
            later = rank >= some
            x, y, some = x[later], y[later], 16 * some

    def _top(self, k: int) -> int:
        while self.root[k] != k:
            k = self.root[k]
        return k


def _each_tile(batches):
    """The tile and its columns, the tile's among them, for each tile of sorted batches."""
    now, held = None, None
    for b in batches:
        tiles = b.column(0).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]])) if len(tiles) else []
        columns = [c.to_pylist() for c in b.columns]
        for s, e in zip(cut, cut[1:], strict=False):
            some = [c[s:e] for c in columns]
            if held is not None and tiles[s] == now:
                for h, c in zip(held, some, strict=True):
                    h += c
                continue
            if held is not None:
                yield now, held
            now, held = tiles[s], some
    if held is not None:
        yield now, held
