import numpy as np
import pytest

from quernis.llm import packing
from tests.llm.common import DOCS, awkward, corpus

P = pytest.importorskip("public_tokenizers")


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [r for r in corpus(31) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = packing.pack(awkward(spark.createDataFrame(rows, DOCS)), P.path("byte_bpe_50k.json"), length=64).collect()
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for d, text, *_ in rows:
        want = (plain.encode(text, add_special_tokens=False).ids if text else []) + [0]
        pieces = sorted(docs[d], key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4")] == want
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) // 4 for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert n <= 64 and n & (n - 1) == 0


def test_odd_rows(spark):
    rows = corpus(32)
    got = packing.pack(spark.createDataFrame(rows, DOCS), P.path("byte_bpe_50k.json")).collect()
    assert sum(1 for r in got if r.doc_id is None) >= 2 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert not packing.pack(spark.createDataFrame([], DOCS), P.path("byte_bpe_50k.json")).collect()


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
