import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenframe.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def expand(runs, capacity):
    bins = {}
    for r in runs:
        for i in range(r.count):
            bins.setdefault(r.first_bin + i // r.per_bin, []).append((r.offset + i % r.per_bin * r.length, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def first_fit_decreasing(histogram, capacity):
    gaps = []
    for k in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        i = next((i for i, g in enumerate(gaps) if g >= k), None)
        if i is None:
            gaps.append(capacity - k)
        else:
            gaps[i] -= k
    return len(gaps)


def test_plans_are_whole_and_tight():
    for seed in range(150):
        rnd = random.Random(seed)
        capacity = rnd.choice([10, 31, 64, 2048])
        histogram = {}
        for _ in range(rnd.randrange(300)):
            k = rnd.randint(1, capacity if rnd.random() < 0.5 else max(1, capacity // 4))
            histogram[k] = histogram.get(k, 0) + 1
        bins = expand(P.plan(histogram, capacity), capacity)
        assert sum(map(len, bins.values())) == sum(histogram.values())
        assert sorted(bins) == list(range(len(bins)))
        assert all(sum(3 * k > capacity for _, k in items) <= 2 for items in bins.values())
        assert len(bins) <= first_fit_decreasing(histogram, capacity) + 1


def test_word_ids_equal_whole_text_encoding(spark):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [
        "Hello, it's A test's end 'RE don't  x", "é café É b", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "", "日本語 テキスト, 12345 ...!!\t\n\x0b",
        "İstanbul ſ K  wide　space \x1f control", "word " * 5000, "́ starts with a mark", "a ́b",
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(100, None, "z"), (0, texts[0], "z")], "doc_id long, text string, length string")
    rows = P.pack_documents(docs, PATH, capacity=64).collect()
    want = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)} | {100: [0]}
    seen = {}
    for r in rows:
        own = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == 64 * r.piece
        seen.setdefault(r.doc_id, []).append(r.length)
    assert {k: sum(v) for k, v in seen.items()} == {k: len(v) * (2 if k == 0 else 1) for k, v in want.items()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert P.pack_documents(docs.limit(0), PATH).collect() == []
