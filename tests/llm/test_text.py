import random

import numpy as np
import pyarrow as pa
import pytest

from quernis.llm import text as t
from quernis.llm import tokens
from tests.llm.common import corpus, words


def test_words_and_shingles_match_plain_ones():
    texts = [r[1] for r in corpus(2)]
    for arr in (pa.array(texts, pa.string()), pa.array([None, *texts], pa.string()).slice(1), pa.array([], pa.string())):
        h, at = t.word_hashes(arr)
        names = {}
        for k, x in enumerate(arr.to_pylist()):
            mine = words(x)
            assert at[k + 1] - at[k] == len(mine)
            for w, v in zip(mine, h[at[k] : at[k + 1]], strict=True):
                assert names.setdefault(w, v) == v
        assert len(set(names.values())) == len(names)
    x, y = t.word_hashes(pa.array(["a b a b c", "B a"]))[0][:5], t.word_hashes(pa.array(["a b a b c", "B a"]))[0][5:]
    assert len(t.shingles(x, 2)) == 3 and len(t.shingles(x, 9)) == 1 and len(t.shingles(x[:0], 2)) == 0
    assert t.shingles(y, 2)[0] in t.shingles(x, 2)


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array([None if r[1] is None else r[1] for r in corpus(3)], pa.string())
    whole = t.word_hashes(texts)
    monkeypatch.setattr(t, "PIECE", 97)
    cut = t.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


ODD = [" ", "  ", "\n", "\t", "a", "b'", "'s", "'ll", "9", "é", "\u00a0", "\u3000", "\x1c", "<|endoftext|>", "<|startoftext|>", "!", "中", ".", "Word", "</w>"]


def odd_texts(seed):
    rng = random.Random(seed)
    return [r[1] for r in corpus(4)] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def test_token_ids_equal_those_of_the_tokenizer():
    """Of a byte-level file, added tokens included, and of one that needs the tokenizer itself."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    for name, fast in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        plain, own = Tokenizer.from_file(P.path(name)), tokens.Encoder(P.path(name))
        assert bool(own.fast) == fast and own.size == plain.get_vocab_size()
        texts = [*odd_texts(5), " " * 50_000, "x" * 50_000, "a <|endoftext|> b"]
        for x, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == (plain.encode(x, add_special_tokens=False).ids if x else [])


def test_changed_files_are_not_taken_for_plain_ones(tmp_path):
    import json

    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for part, value in (("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})):
        with open(tmp_path / "t.json", "w", encoding="utf-8") as f:
            json.dump(spec | {part: value}, f)
        own = tokens.Encoder(str(tmp_path / "t.json"))
        assert own.fast is None and own.encode(["Ab", None])[1] == b""
        assert np.frombuffer(own.encode(["Ab"])[0], "<u4").tolist() == own.whole.encode("Ab", add_special_tokens=False).ids
