"""One-permutation MinHash: neighbours and edits against a plain loop, likeness against exact Jaccard similarity."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.llm import one_permutation as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = ["".join(random.choice("abcdefgäé漢😀") for _ in range(random.randrange(1, 9))) for _ in range(3000)]
    out = [random.choice([" ", "  ", "\n"]).join(random.choice(words) for _ in range(random.choice([0, 1, 2, 4, 5, 6, 40, 300, 2000]))) for _ in range(150)]
    return out + [out[8]] * 3 + [out[9].upper(), None, "", " \n", "x", "word " * 20_000]


def test_compared(spark, texts):
    ids = random.Random(2).sample(range(-1000, 10_000), len(texts))
    docs = list(zip(ids, texts))
    frame = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, p int, head string").repartition(6)
    got = {r.doc_id: r for r in op.compared(frame, ranges=7).collect()}
    assert len(got) == len(docs)
    docs.sort(key=lambda d: d[0])
    errors = []
    for k, (i, text) in enumerate(docs):
        text, after, r = text or "", docs[(k + 1) % len(docs)][1] or "", got[i]
        e = len(text) // 4
        edited = text[: len(text) - e] + after[:e]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints = op.packed(op.sketches([text, edited]))
        assert [r.fingerprint, r.edited_fingerprint] == prints and len(r.fingerprint) == 512
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(shingles(text)) > 200:
            errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.01 and len(errors) > 40
    found = {r.doc_id: r for r in op.fingerprints(frame).collect()}
    assert all(found[i].fingerprint == got[i].fingerprint for i, _ in docs)
    assert len({got[i].fingerprint for i, t in docs if t == texts[8]}) == 1
    near = frame.sparkSession.createDataFrame([(got[i].fingerprint, got[i].edited_fingerprint, got[i].near_edited) for i, _ in docs] + [(None, "00", None)], "a string, b string, want double")
    assert near.where(~op.likeness(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0


def test_ties_nulls_and_one_key(spark):
    """Rows that share an id, a third of which are equal, follow one another; nulls come first; the last meets the first."""
    random.seed(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(7, " ".join(random.choices(words, k=30))) for _ in range(20)]
    rows += [rows[0]] * 300 + [(i, " ".join(random.choices(words, k=20))) for i in range(5, 60)] + [(None, "no id a"), (None, "no id b"), (None, None)]
    for ranges in (1, 5):
        got = op.compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), ranges=ranges).collect()
        assert len(got) == len(rows)
        hashed = {x.text: x.h for x in spark.createDataFrame([(t or "",) for _, t in rows], "text string").distinct().withColumn("h", F.xxhash64("text")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""]))
        want = []
        for k, (i, t) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            e = len(t) // 4
            want.append((i, hashlib.sha256((t[: len(t) - e] + after[:e]).encode()).hexdigest()))
        assert sorted(map(repr, ((r.doc_id, r.edited_sha256) for r in got))) == sorted(map(repr, want))
    names = spark.createDataFrame([("b", "one two"), ("a", "three four five"), (None, "six")], "name string, body string")
    assert {(r.name, r.near_edited >= 0) for r in op.compared(names, "body", "name").collect()} == {("a", True), ("b", True), (None, True)}
    assert op.compared(names.limit(0), "body", "name").count() == 0
    (one,) = op.compared(names.limit(1), "body", "name").collect()
    assert one.near_next == 1.0


def test_densification():
    """A text's empty bins take the value of the first full bin in their own order, for few and for many full bins."""
    order, rank = op.visiting_order(64)
    assert all(sorted(x) == list(range(64)) for x in order.tolist()) and (np.take_along_axis(rank, order, 1) == np.arange(64)).all()
    rng = np.random.default_rng(1)
    full = np.array([rng.permutation(64) < m for m in (0, 1, 2, 23, 24, 40, 64)])
    least = rng.integers(1, 1 << 60, full.shape).astype(np.uint64)
    out = op.densified(least, full)
    for d in range(len(full)):
        for i in range(64):
            want = 0 if not full[d].any() else least[d, i] if full[d, i] else next(least[d, j] for j in order[i] if full[d, j])
            assert out[d, i] == want


@pytest.mark.parametrize(("bins", "bits"), [(256, 1), (512, 4), (1024, 8)])
def test_likeness_is_unbiased(bins, bits):
    random.seed(9)
    for share in (0.0, 0.3, 0.8):
        errors = []
        for k in range(30):
            n = 1500
            both = [f"s{k} {i}" for i in range(int(n * share))]
            a = " ".join(both + [f"a{k}x{i}" for i in range(n - len(both))])
            b = " ".join(both + [f"b{k}x{i}" for i in range(n - len(both))])
            x, y = op.sketches([a, b], bins=bins, bits=bits)
            chance = 0.5**bits
            errors.append(((x == y).mean() - chance) / (1 - chance) - jaccard(a, b))
        assert abs(np.mean(errors)) < 0.03, (share, np.mean(errors))
