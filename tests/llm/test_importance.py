"""Importance resampling against a plain loop; the n-gram table with colliding keys, long words and slices."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from orthospark.llm import importance, ngram_table
from orthospark.llm.common import ALNUM, Text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def features(text, most=2):
    words = WORD.findall(lower(text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)], len(words)


def bucket(f):
    return crc32(f.encode()) % 10_000


def brute(docs, target):
    s = Counter(bucket(f) for _, t in docs for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        own, n = features(text)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = may[: 25 * len(may) // 100]
    return rows, drawn


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    words = ["".join(random.choice("abcdefgäé漢") for _ in range(random.randrange(1, 9))) for _ in range(400)]
    out = [random.choice([" ", ", ", "\n", "-", "\x00"]).join(random.choice(words) for _ in range(random.choice([0, 1, 2, 19, 20, 60, 200]))) for _ in range(200)]
    return out + [out[3]] * 4 + [None, "", "?! ...", "Ä Ö a_b A1", "x" * 40_000 + " " + "y" * 70 + " z " * 30, "Word word " * 40_000]


def test_resample(spark, texts):
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[7]), (None, texts[8])]
    target = [texts[5], (texts[6] or "").upper(), None, "", "new words that no document has"]
    frame = spark.createDataFrame([(*d, 0, "n") for d in docs], "doc_id long, text string, rank int, n_features string").repartition(5)
    bench = spark.createDataFrame([(x, 1) for x in target], "text string, bucket int")
    got = importance.resample(frame, bench).collect()
    rows, drawn = brute(docs, target)
    assert sorted(map(repr, ([r.doc_id, r.n_features, r.weight, r.score] for r in got))) == sorted(map(repr, (r[:4] for r in rows)))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert {(r.doc_id, r.n_features, r["rank"]) for r in importance.resample(some, none).collect()} == {(1, 3, None), (2, 0, None)}


def test_hashes_of_stretches():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000).astype(np.uint8).tobytes()
    padded = np.frombuffer(raw + bytes(72), dtype=np.uint8)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    for size in range(1, ngram_table.SHORT + 1):
        start = rng.integers(0, 5000 - size, 20)
        assert ngram_table.xxh64_values(eight, start, size).tolist() == [xxhash.xxh64_intdigest(raw[a : a + size]) for a in start]
        assert ngram_table.crc_values(padded, start, size).tolist() == [crc32(raw[a : a + size]) for a in start]


def test_slots_verify_bytes(texts, monkeypatch):
    """Keys that collide on purpose still get slots of their own; slices cut between words lose no run."""
    monkeypatch.setattr(ngram_table, "SLICE_WORDS", 50)
    monkeypatch.setattr(ngram_table, "SLICE_BYTES", 400)
    some = [t for t in texts[:60] + texts[-7:-1]]
    want = Counter((d, f) for d, t in enumerate(some) for f in features(t, 3)[0])
    found = Counter()
    for slots, doc in ngram_table.slices(Text(pa.array(some), lower=True).words(ALNUM), 3, 10_000):
        hard = ngram_table.Slots(slots.raw, slots.start, slots.start + slots.length, 10_000, key=lambda x: len(x) % 5)
        for one in (slots, hard):
            runs = [one.raw[a : a + n].decode() for a, n in zip(one.start.tolist(), one.length.tolist())]
            assert len({(s, r) for s, r in zip(one.slot.tolist(), runs)}) == len(set(runs)) == len(one.used)
            assert all(one.bucket[s] == bucket(r) for s, r in zip(one.slot.tolist(), runs))
            assert {r: int(one.count[s]) for s, r in zip(one.slot.tolist(), runs)} == Counter(runs)
        found.update(zip(doc.tolist(), runs))
    assert found == want
