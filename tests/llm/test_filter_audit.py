"""The filter audit against a plain loop over orders and documents, and against its SQL."""

import itertools
import random
import re
from collections import defaultdict

from orthospark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(docs, labels):
    fails, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    for k, (i, text, _) in enumerate(docs):
        text = text or ""
        words = WORD.findall(text)
        fails[k] = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in docs),
        }
    out, shapley = {}, defaultdict(int)
    for part in {p or "" for _, _, p in docs}:
        own = [k for k, (_, _, p) in enumerate(docs) if (p or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, x in enumerate(order, 1):
                failing = {k for k in own if fails[k][x]}
                gone = failing & left
                out[part, "".join(order), step] = [len(left - gone), len(gone), len(failing - left), sum(sum(fails[k].values()) == 1 for k in failing), sum(good[docs[k][0]] for k in gone), sum(toxic[docs[k][0]] for k in gone)]
                shapley[part, x] += len(gone)
                left -= gone
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def test_audit(spark):
    random.seed(3)
    words = ["".join(random.choice("abcdeé") for _ in range(4)) for _ in range(60)]

    def text():
        n = random.choice([0, 3, 49, 50, 80])
        return random.choice(["", "", "#", "$5 "]) + random.choice([" ", "\n", "\x0b\t"]).join(random.choice(words[: random.choice([5, 60])]) for _ in range(n)) + random.choice(["", "ABCDEFGHIJKLMNOP", "\u2028x\u00a0y", "É"])

    docs = [(i, text(), random.choice(["a", "b", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[7][1], random.choice(["a", "c"])) for i in range(20)]  # copies over parts
    docs += [(i, docs[i][1], "b") for i in (7, 7, 8)] + [(None, docs[7][1], "a"), (None, docs[9][1], "a"), (None, "only", "d"), (None, "only", "d"), (200, None, "a"), (201, "", "a"), (202, "Word " * 200_000, "e")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1])) for i in range(0, 120, 2)] + [(8, 1, 1), (8, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, mask string, n int")
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, digest string")
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    rows = filter_audit.audit(frame, marks).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in rows}
    assert len(rows) == len(got) == 600 * 6
    assert got == brute(docs, labels)

    import duckdb

    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    con.register("labels", marks.toArrow())
    found = con.execute(filter_audit.ORACLE_SQL)
    names = [x[0] for x in found.description]
    assert {(r[0], r[1], r[2]): [r[names.index(c)] for c in COLUMNS] for r in found.fetchall()} == got


def test_many_parts_and_empty(spark):
    many = spark.range(4000).selectExpr("id AS doc_id", "'a b' AS text", "cast(id AS string) AS source")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(many, none)
    assert found.count() == 4000 * 600  # more recursion rows than Spark's own limit lets through
    assert found.where("step = 1 AND filter_order LIKE 'A%' AND removed <> 1").count() == 0
    assert filter_audit.audit(many.limit(0), none).count() == 0
