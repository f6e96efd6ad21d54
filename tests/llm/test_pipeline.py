import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from lumenframe.llm.linefreq import LINE_LIMIT
from lumenframe.llm.queries import tokenizer_path

BOILER = "Subscribe to our letter and never miss a story again"


def make(spark, folder):
    rnd = random.Random(11)
    words = [a + b for a in "bcdfghklm" for b in ("an", "er", "ion", "ost", "ul")]
    rows = []
    for i in range(160):
        text = " ".join(rnd.choice(words) + str(rnd.randrange(50)) for _ in range(rnd.randrange(30, 120)))
        if i % 7 == 0:
            text += f'\napi_key = "{rnd.getrandbits(128):032x}"'
        if i < LINE_LIMIT + 20:
            text += "\n" + BOILER
        rows.append((i, text, "en", "s0" if i < LINE_LIMIT + 20 else f"s{i % 4}", len(text)))
    for i in range(160, 200):  # copies with one word changed, of the later documents
        w = rows[120 + i % 40][1].split(" ")
        w[3] = "changed"
        rows.append((i, " ".join(w), "en", "s1", 1))
    rows += [(500, None, "en", "s2", 0), (501, "", "en", None, 0), (502, "short text", "en", "s2", 10), (503, "loop the loop now " * 30, "en", "s2", 500)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    return rows


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_against_brute_force(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, steps = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append(docs.collect())
        assert k == 4 or docs.columns == columns
    quality, near, clean, mixed, packed = steps

    kept = {r.doc_id: r for r in quality}
    assert sorted(kept) == [r[0] for r in rows if r[0] < 500]
    assert BOILER in kept[0].text and all(BOILER not in kept[i].text for i in range(1, LINE_LIMIT + 20))
    assert all(r.n_chars == len(r.text) for r in quality if r.doc_id < 160)

    root = {r.doc_id: r.doc_id for r in quality}
    sets = {r.doc_id: shingles(r.text) for r in quality}
    ids = sorted(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near) == sorted({find(i) for i in ids}) and len(near) < len(quality)

    assert len(clean) == len(near) and not any(re.search("[0-9a-f]{24}", r.text) for r in clean)
    assert sum("[assign]" in r.text for r in clean) == sum("api_key" in r.text for r in near)

    texts = {r.doc_id: r.text for r in clean}
    copies = {}
    for r in mixed:
        assert texts[r.doc_id] == r.text
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces, bins = {}, {}
    for r in packed:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(ids) <= 2048
    assert {k: v for k, v in pieces.items()} == {k: n * len(tokenizer.encode(texts[k], add_special_tokens=False).ids + [0]) for k, n in copies.items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.run(spark, str(tmp_path)).count() == len(packed)
