"""Token ids of whole texts by a public tokenizer file.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, added
tokens in the text included. A plain byte-level BPE, told by its file's fields,
is encoded by ``tiktoken``, which merges by rank and so gives the same ids some
five times faster; any other file by ``tokenizers`` itself. No cache is kept, so
memory follows the longest text.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: how a byte-level BPE splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MADE: dict[str, Encoder] = {}


def _bytes_of() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ranks if the file is a plain byte-level BPE, whose ids rise with its merges."""
    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = spec.get("added_tokens") or []
    exact = not any(t.get(k) for t in added for k in ("normalized", "single_word", "lstrip", "rstrip"))
    apart = not any(a is not b and a["content"] in b["content"] for a in added for b in added)
    if not (plain and level and exact and apart) or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return None
    byte = _bytes_of()
    special = {t["content"] for t in added}
    words = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [words.get("".join(m)) for m in merged]
    rising = None not in ids and all(a < b for a, b in zip(ids, ids[1:], strict=False))
    if not rising or len(words) != 256 + len(merged) or any(c not in words for c in byte) or any(c not in byte for w in words for c in w):
        return None
    return {bytes(byte[c] for c in w): i for w, i in words.items()}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        if ranks:
            special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
            self.fast = tiktoken.Encoding("quernis", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.whole, self.size = None, max([*ranks.values(), *special.values()]) + 1
        else:
            self.fast, self.whole = None, Tokenizer.from_file(path)
            self.size = self.whole.get_vocab_size()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _MADE:
            _MADE[path] = cls(path)
        return _MADE[path]

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; null counts as empty."""
        if not text:
            return np.zeros(0, "<u4")
        if self.fast:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [self.ids(t).tobytes() for t in texts]
