"""Small tables with awkward rows, and plain versions of shared steps."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int, stock: str = "the of and tion ing er on re an ent is at") -> str:
    parts = stock.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Originals, exact and near copies, junk, nulls, blanks, a long text and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    for base in texts[:8]:
        for edits in (0, 0, 1, 3, 8):
            w = base.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "one", "!!! 123 ...", "two words", "TWO  words", "é à ü", prose(rng, 30_000), "a " * 3000, "Ünï cödé   nbsp em  double   blank \n line\r\nnext"]
    rows = [(i * 3, t, rng.choice(["en", "fr", "de", None]), rng.choice(["a", "b", "c", "d", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[2], "en", "a", 5), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if w else [])


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def awkward(df):
    """The same table with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for c in ("node", "key", "label", "sig", "row", "size", "copies", "part", "rep", "line", "k", "a.b"):
        df = df.withColumn(c, F.lit("x"))
    return df
