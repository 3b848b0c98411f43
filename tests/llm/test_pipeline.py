import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quernis.llm import mixing
from tests.llm.common import DOCS, awkward, prose
from tests.llm.test_langid import STOCK
from tests.llm.test_lines import brute as repeated
from tests.llm.test_minhash import brute as near

P = pytest.importorskip("public_tokenizers")


def documents():
    rng = random.Random(3)
    rows = []
    for i in range(90):
        v = list(STOCK)[i % 4]
        text = "\n".join(prose(rng, rng.randint(6, 30), STOCK[v]) for _ in range(rng.randint(1, 5)))
        rows.append([i, text, v, f"s{i % 3}", 0])
    for i in range(20):
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "zzz"
        rows.append([200 + i, " ".join(words), rows[i][2], rows[i][3], 0])
    rows += [[300 + i, rows[i][1], rows[i][2], None, 0] for i in range(10)]
    rows += [[400, None, "en", "s0", 0], [401, "", "en", "s0", 0], [402, "123 !!!", None, "s1", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    return [tuple(r) for r in rows]


def test_each_stage_against_a_plain_one(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as c

    rows = documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in c.STAGES:
        docs = c.Scratch(spark, "t").put(name, stage(spark, docs, str(tmp_path)))
        after[name] = [tuple(r) for r in docs.collect()]
        assert name == "pack" or docs.columns == [f.split()[0] for f in DOCS.split(", ")]
    kept = [r for r in rows if any(x.isalpha() for x in r[1] or "")]
    assert sorted(after["language_id"]) == sorted(kept)
    want = repeated(kept)[2]
    texts = {r[0]: "\n".join(x for i, x in enumerate(r[1].split("\n")) if (r[0], i) not in want) for r in kept}
    lines = {d: t for d, t in texts.items() if t.strip() or not any(g[0] == d for g in want)}
    assert {r[0]: r[1] for r in after["line_dedup"]} == lines and all(r[4] == len(r[1]) for r in after["line_dedup"])
    stay = {r[0] for r in near(after["line_dedup"], 5) if r[3]}
    assert {r[0] for r in after["near_dedup"]} == stay and len(after["near_dedup"]) == len(stay)
    copies = {r.doc_id: r.copies for r in mixing.copies(spark.createDataFrame(after["near_dedup"], DOCS)).collect()}
    assert Counter(r[0] for r in after["mix_sources"]) == Counter({d: n for d, n in copies.items() if n})
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r[0]: [*plain.encode(r[1], add_special_tokens=False).ids, 0] for r in after["mix_sources"]}
    names = docs.columns
    packed = [dict(zip(names, r, strict=True)) for r in after["pack"]]
    for r in packed:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert bytes(r["ids"]) == own and r["ids_crc32"] == zlib.crc32(own) and r["doc_tokens"] == len(ids[r["doc_id"]])
    times = Counter()
    for r in packed:
        times.update({(r["doc_id"], r["start"] + k): 1 for k in range(r["length"])})
    assert all(times[d, k] == copies[d] for d, x in ids.items() for k in range(len(x))) and len(times) == sum(map(len, ids.values()))
    whole = [tuple(r) for r in c.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()]
    assert Counter((r[0], r[4]) for r in whole if not r[1]) == Counter({(d, len(x)): copies[d] for d, x in ids.items()})


def test_odd_rows(spark, tmp_path):
    """Null ids and columns, ids on many rows, clashing column names, a long text."""
    import corpus_pipeline as c

    rng = random.Random(5)
    a, b = (prose(rng, 40, STOCK["en"]) for _ in range(2))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (None, a, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, prose(rng, 30_000, STOCK["de"]), "de", None, None)]
    df = awkward(spark.createDataFrame(rows, DOCS))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in c.STAGES:
        docs = c.Scratch(spark, "t").put(name, stage(spark, docs, str(tmp_path)))
        assert name == "pack" or docs.columns == df.columns
        if name in ("line_dedup", "near_dedup"):
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter((r[0], r[1]) for r in (rows[0], rows[1], rows[3], rows[6]))
    assert c.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_corpus(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
    assert np.array(c.STAGES, object).shape == (5, 2)
