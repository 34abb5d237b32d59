"""Near copies against brute-force Jaccard similarity of five-word shingles: none but true links, and nearly all of them."""

import random
import re

import pytest

from orthospark.llm import near_copies
from orthospark.llm.simhash import fingerprint_values

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def set_of(text):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    """The least number of each text's group."""
    sets, root = [set_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    random.seed(11)
    words = ["".join(random.choice("abcdefgäé") for _ in range(random.randrange(2, 7))) for _ in range(400)]
    line = [random.choice(words) for _ in range(12)]
    out = [None, "", " \n", "x", "X", "x y", "x y z", "one Two three four", "one two three four", "one two three four five"]
    for size in (6, 9, 14, 30, 60, 61, 150, 700):
        base = [random.choice(words) for _ in range(size)]
        out.append(" ".join(base))
        for changes in (1, 1, 2, 3, size // 50, size // 45, size // 40, size // 20):
            own = list(base)
            for at in random.sample(range(size), min(size, changes)):
                own[at] = random.choice(words)
            out += [" ".join(own), " ".join(base[changes:]), " ".join(line + own), " ".join(own) + "\n" + " ".join(line)]
    base = [random.choice(words) for _ in range(80)]
    for _ in range(60):  # a crowd of copies of one text
        own = list(base)
        own[random.randrange(80)] = "changed" + random.choice(words)
        out.append(" ".join(own))
    random.shuffle(out)
    return out


def test_near_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = groups(texts)
    stay = set(want)
    for block, share in ((4096, 16), (8, 1)):  # the second cuts crowded anchors into blocks
        got = {r.doc_id for r in near_copies.keep(docs, block=block, share=share).collect()}
        assert stay <= got and len(got - stay) <= 0.03 * (len(texts) - len(stay))
    assert near_copies.keep(docs).columns == ["doc_id", "text"] and near_copies.keep(docs.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just over and just under a similarity of 0.8, and everything between 0.8 and 1."""
    random.seed(12)
    texts, similarity = [], []
    for k in range(400):
        base = [f"w{random.randrange(10**6)}" for _ in range(random.choice([60, 150, 400, 1200]))]
        other, at = list(base), list(range(0, len(base) - 5, 10))
        random.shuffle(at)
        for x in at:
            other[x] = f"n{random.randrange(10**6)}"
            a, b = set_of(" ".join(base)), set_of(" ".join(other))
            if len(a & b) / len(a | b) < random.choice([0.77, 0.8, 0.83, 0.88, 0.95]):
                break
        texts += [" ".join(base), " ".join(other)]
        similarity.append(len(a & b) / len(a | b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in near_copies.keep(docs).collect()}
    caught = [2 * k + 1 not in got for k in range(len(similarity))]
    assert not any(c for c, s in zip(caught, similarity) if s < 0.8)
    edge = [c for c, s in zip(caught, similarity) if 0.8 <= s < 0.84]
    rest = [c for c, s in zip(caught, similarity) if s >= 0.84]
    print(len(edge), sum(edge) / len(edge), len(rest), sum(rest) / len(rest))
    assert len(edge) > 50 and len(rest) > 50 and sum(edge) >= 0.95 * len(edge) and sum(rest) >= 0.99 * len(rest)


def test_missing_and_repeated_ids(spark):
    """One row a group, whichever order the rows come in; texts of rows with one id are judged on their own."""
    long, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    # Columns with names that the stage might use for itself are carried as they are.
    rows = [(5, long), (5, long), (None, long + " end"), (None, "alone here"), (None, "alone here"), (7, "other"), (1, other), (3, long + " x"), (3, other), (None, None), (9, ""), (None, other)]
    for own in (rows, rows[::-1]):
        got = near_copies.keep(spark.createDataFrame([(*r, "z", 1, 7) for r in own], "doc_id long, text string, node string, hash int, _near_hash long")).collect()
        assert sorted(((r.doc_id or 0, r.text) for r in got), key=str) == sorted([(0, "alone here"), (3, long + " x"), (7, "other"), (1, other), (9, "")], key=str)
        assert all(r.node == "z" and r["hash"] == 1 and r["_near_hash"] == 7 for r in got)


def test_a_crowd_below_the_threshold_proposes_few_pairs(spark, monkeypatch):
    """Texts of one template at a similarity of about 0.75: a small share of their pairs is verified, and true copies among them are found."""
    import pyarrow as pa

    rng, counts = random.Random(4), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def crowd(n):
        out = []
        for k in range(n):
            own = list(base)
            for at in rng.sample(range(0, 390, 6), 6):
                own[at] = f"n{k}x{at}"
            out.append(" ".join(own))
        return out

    near = near_copies.verified

    def counted(pairs, *rest):
        counts[-1] += pairs.count()
        return near(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    for n in (150, 600):
        texts = crowd(n)
        copies = [t.replace("w", "w", 1) + f" more{k} words{k}" for k, t in enumerate(texts[:20])]
        counts.append(0)
        docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
        got = {r.doc_id for r in near_copies.keep(docs).collect()}
        want = set(groups(texts + copies)) if n == 150 else None
        assert want is None or (want <= got and len(got - want) <= 2)
    sample = [set_of(t) for t in texts[:40]]
    mean = [len(a & b) / len(a | b) for i, a in enumerate(sample) for b in sample[:i]]
    assert 0.6 < sum(mean) / len(mean) < 0.78
    assert counts[1] < 0.03 * 620 * 619 / 2  # narrow sketches alone let 40 % of all pairs through
    assert len(near_copies.parities(*near_copies.sets(pa.array(texts[:3]))[:2], 4096)) == 3


def test_many_rows_without_id(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "case when id % 3 = 0 then 'a crowd of equal texts without an id' else concat('text number ', id) end as text")
    assert near_copies.keep(docs).count() == 20_000 - 6667 + 1


def test_pipeline_stage_drops_what_four_bits_miss(spark):
    """Fails with fingerprints at most 4 bits apart: similarity 0.8 lies further apart."""
    import corpus_pipeline
    import pyarrow as pa

    random.seed(2)
    base = [f"w{random.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)]
    for k in range(12):
        own = list(base)
        for at in (20, 90, 160):
            own[at] = f"n{k}x{at}"
        texts.append(" ".join(own))
    fp = fingerprint_values(pa.array(texts)).tolist()
    assert set(groups(texts)) == {0} and any(min((a ^ b).bit_count() for b in fp if a != b) > 4 for a in fp)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
