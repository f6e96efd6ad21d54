import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chroma as C


def test_chroma_of_a_tone_and_silence():
    t = np.arange(8000) / C.RATE
    for k in range(12):
        assert (C.chroma(np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t)).argmax(axis=1) == k).all()
    assert not C.chroma(np.zeros(5000)).any() and len(C.chroma(np.zeros(100))) == 0
    assert C.fingerprint(C.chroma(np.zeros(20_000)))[1].all()


def test_box_sums_and_filters():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1000, (30, 12))
    image, wide = C.integral(x), np.concatenate([x, x], axis=1)
    assert C._box(image, 2, 7, 3, 15, 10).tolist() == [wide[i + 2 : i + 7, 3:15].sum() for i in range(10)]
    for shape, y, h, w in C.FILTERS:
        assert w <= C.WIDTH and y + h <= 24
        got = C.filter_values(image, shape, y, h, w, 30 - C.WIDTH + 1)
        for i in range(30 - C.WIDTH + 1):
            part = wide[i : i + w, y : y + h]
            one = np.zeros((w, h), bool)
            if shape == "halves_pitch":
                one[:, h // 2 :] = True
            elif shape == "halves_time":
                one[w // 2 :] = True
            elif shape == "cross":
                one[: w // 2, h // 2 :] = one[w // 2 :, : h // 2] = True
            elif shape == "thirds_pitch":
                one[:, h // 3 : h - h // 3] = True
            elif shape == "thirds_time":
                one[w // 3 : w - w // 3] = True
            a, b = (part.sum(), C.SCALE * w * h / 12**0.5) if shape == "all" else (part[one].sum(), part[~one].sum())
            assert np.isclose(got[i], np.log((C.SCALE + a) / (C.SCALE + b)))


def test_no_bit_is_predictable_and_tiles_and_note_tables_change_nothing(monkeypatch):
    notes = np.random.default_rng(7).integers(0, C.NOTES, 3000)
    items, silent, doubts = C.fingerprint(C.normalised(C.note_chroma(notes)))
    shares = [float((items >> k & 1).mean()) for k in range(32)]
    assert 0.4 < min(shares) and max(shares) < 0.6 and not silent.any()
    rendered = C.chroma(C._tone_table(C.RATE, C.HOP)[notes].ravel())
    assert (C.fingerprint(rendered)[0] == items).all()
    monkeypatch.setattr(C, "TILE", 100)
    assert all((a == b).all() for a, b in zip(C.fingerprint(rendered), (items, silent, doubts)))


def lookups(x, y, u, v):
    """The keys of two neighbouring integers: as they are, and with any of their least sure bits flipped."""
    bits = [1 << (d >> 5 * k & 31) + above for d, above in ((u, 32), (v, 0)) for k in range(C.DOUBTS)]
    return {(x << 32 | y) ^ sum(z) for n in range(len(bits) + 1) for z in combinations(bits, n)}


def votes_needed(a, b, min_votes):
    return min(min_votes, -(-(min(len(a), len(b)) - 1) // 4))


def brute(prints, asks, min_votes, max_error):
    """Every pair at every offset."""
    out = {}
    for q in asks:
        a, _, doubts = prints[q]
        near = [lookups(*x) for x in zip(a, a[1:], doubts, doubts[1:])]
        for r, (b, _, _) in prints.items():
            if q == r or not a or not b:
                continue
            votes = Counter(j - i for i in range(len(near)) for j in range(len(b) - 1) if b[j] << 32 | b[j + 1] in near[i])
            least = votes_needed(a, b, min_votes)
            good = []
            for offset, n in votes.items():
                both = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
                error = sum(bin(x ^ y).count("1") for x, y in both) / (32 * len(both))
                if n >= least and error <= C.error_limit(len(both), max_error):
                    good.append((n, -abs(offset), offset, len(both), round(error, 9)))
            if good:
                n, _, offset, overlap, error = max(good)
                out[q, r] = (offset, n, overlap, error)
    return out


def test_alignment_matches_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    song = [rnd.choice(words) for _ in range(120)]
    rows = []
    for i in range(24):
        own = [rnd.choice(words) for _ in range(60)]
        at = rnd.randrange(50)
        rows.append((i, 0, " ".join(own[:20] + song[at : at + 50] + own[20:])))
    rows += [(30, 0, rows[0][2]), (31, 0, None), (32, 0, "too short"), (33, 0, ""), (40, 3, rows[5][2]), (40, 3, rows[5][2])]
    rows += [(50 + k, 1, " ".join(song[30 : 47 + k])) for k in range(12)]  # down to one integer
    rows += [(None, 1, "x"), (None, 0, rows[3][2]), (80, None, " ".join(song)), (80, 0, rows[7][2]), (80, 0, " ".join(song[::-1])), (80, 2_000_000, rows[9][2])]
    conversations = spark.createDataFrame([(c, t, x, "user") for c, t, x in rows], "conv_id long, turn int, text string, offset string")
    prints = C.settle(C.spoken_turns(conversations))
    got = C.align(prints, F.col("conv_id") % 20 == 0).collect()
    members = [r for r in got if r.match_id is None]
    assert sorted(((r.conv_id, r.turn) for r in members), key=str) == sorted(((c, t) for c, t, _ in rows), key=str)
    assert sum(r.class_id is None for r in members) == 4 and all((r.class_id is None) == (r.n_items == 0) for r in members)
    sound = {(r.conv_id, r.turn, len(r["items"]), tuple(r["items"])) for r in prints.collect()}
    texts, reps = {}, {}
    for c, t, x in rows:
        own = tuple(v.tolist() for v in C.fingerprint(C.normalised(C.note_chroma(C.notes_of((x or "").encode().split())))))
        assert (c, t, len(own[0]), tuple(own[0])) in sound
        texts.setdefault(tuple(own[0]), []).append((c, t))
        reps[tuple(own[0])] = own
    classes = {frozenset((r.conv_id, r.turn) for r in members if r.class_id == k) for k in {r.class_id for r in members} - {None}}
    assert classes == {frozenset(v) for k, v in texts.items() if k}
    asks = [k for k, v in texts.items() if any(c is not None and c % 20 == 0 for c, _ in v) and k]
    want = brute({k: v for k, v in reps.items() if k}, asks, C.MIN_VOTES, C.MAX_BIT_ERROR)
    name = {frozenset(v): k for k, v in texts.items()}
    named = {k: name[frozenset((r.conv_id, r.turn) for r in members if r.class_id == k)] for k in {r.class_id for r in members} - {None}}
    assert {(named[r.class_id], named[r.match_id]): (r.offset, r.votes, r.overlap, round(r.bit_error, 9)) for r in got if r.match_id is not None} == want
    assert len(want) > 20
    assert C.align(C.settle(C.spoken_turns(conversations.limit(0))), F.lit(True)).collect() == []


def test_noise_and_shift_are_found_in_pcm(spark):
    rng = np.random.default_rng(5)
    song = C.tones([str(rng.integers(1000)).encode() for _ in range(200)])
    noisy = song[40 * C.HOP :] + rng.normal(0, 0.05, len(song) - 40 * C.HOP)
    other = C.tones([str(rng.integers(1000)).encode() for _ in range(200)])
    pcm = lambda x: (np.clip(x / 2, -1, 1) * 32767).astype("<i2").tobytes()
    recordings = spark.createDataFrame([(0, bytearray(pcm(song))), (1, bytearray(pcm(noisy))), (2, bytearray(pcm(other))), (3, None)], "id long, pcm binary")
    prints = C.settle(C.fingerprints(recordings, ["id"], "pcm"))
    got = C.align(prints, F.col("id") == 0).collect()
    ids = {r.class_id: r.id for r in got if r.match_id is None}
    matches = [r for r in got if r.match_id is not None]
    assert [(ids[r.class_id], ids[r.match_id], r.offset) for r in matches] == [(0, 1, -40)] and matches[0].bit_error < 0.1


@pytest.mark.parametrize(("words", "noise", "least"), [(18, 0, 0.5), (20, 0, 0.95), (24, 0, 1), (25, 0.05, 1), (25, 0.2, 0.9), (60, 0.2, 1)])
def test_recall_of_planted_copies(words, noise, least):
    """The share of planted copies that get votes enough at their offset, against their true places."""
    rnd, rng = random.Random(3), np.random.default_rng(4)
    found = 0
    for _ in range(40):
        song = [f"w{rnd.randrange(3000)}".encode() for _ in range(150)]
        at = rnd.randrange(150 - words + 1)
        sound = C.tones(song[at : at + words])
        a, (b, _, d) = C.fingerprint(C.chroma(C.tones(song)))[0].tolist(), C.fingerprint(C.chroma(sound + rng.normal(0, noise, len(sound))))
        b, d = b.tolist(), d.tolist()
        votes = sum(a[at + k] << 32 | a[at + k + 1] in lookups(*x) for k, x in enumerate(zip(b, b[1:], d, d[1:])))
        error = np.mean([bin(a[at + k] ^ x).count("1") for k, x in enumerate(b)]) / 32
        found += votes >= votes_needed(b, b, C.MIN_VOTES) and error <= C.error_limit(len(b))
    print(words, noise, found / 40)
    assert found >= least * 40


def test_unrelated_stretches_stay_above_the_limit():
    rnd = random.Random(9)
    for n in (8, 20, 44):
        passed = 0
        for _ in range(300):
            a, b = [C.fingerprint(C.chroma(C.tones([f"w{rnd.randrange(3000)}".encode() for _ in range(n + 16)])))[0].tolist() for _ in range(2)]
            passed += np.mean([bin(x ^ y).count("1") for x, y in zip(a, b)]) / 32 <= C.error_limit(n)
        assert passed <= 1
