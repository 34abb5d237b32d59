"""The text operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import os
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from orthospark.llm import components, decontaminate, html_diff, langid, licenses, packing, queries, repetition, simhash, token_spans, tool_links, weak_labels
from orthospark.llm.tokens import WordEncoder, tokenizer_path

sys.path.insert(0, os.path.dirname(__file__))
from test_near_copies import groups  # noqa: E402

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, kept int, fp string"  # two columns whose names operators use themselves


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def texts():
    random.seed(7)
    vocabulary = ["".join(random.choice("abcdefgäé") for _ in range(random.randrange(1, 8))) for _ in range(300)]
    out = []
    for i in range(120):
        words = [random.choice(vocabulary) for _ in range(random.choice([0, 1, 3, 5, 40, 120, 300]))]
        if i % 4 == 0 and words:
            words += words[: len(words) // 2]
        out.append(re.sub(r" (\w+) \1 ", r"\n\1.  #", " ".join(words)))
    out += [out[5]] * 6 + [out[9] + " tail"] * 3 + [None, "", " \n\t ", "x", "A" * 50_000, "word " * 30_000]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, 1, "z") for i, t in enumerate(texts)] + [(None, texts[5], "en", 0, None), (3, texts[3], "en", 0, None)]
    return spark.createDataFrame(rows, SCHEMA)


def repetition_of(s, least):
    w = SPACE.findall(s or "")
    n = len(w)
    lines = [x for x in (s or "").split("\n") if SPACE.search(x)]
    count = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    repeated = {j for i in range(n - 2) if count[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    at = defaultdict(list)
    for i in range(n - least + 1):
        at[tuple(w[i : i + least])].append(i)
    covered, longest = set(), 0
    for places in at.values():
        if len(places) > 1:
            covered |= {j for i in places for j in range(i, i + least)}
            for i in places if len(places) < 50 else []:
                for j in places:
                    k = least
                    while i < j and j + k < n and w[i + k] == w[j + k]:
                        k += 1
                    longest = max(longest, k)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in s or ""), len(lines) - len(set(lines)), len(repeated), len(covered), longest


def test_repetition(docs, texts):
    got = {r.doc_id: r for r in repetition.measure(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want, r = repetition_of(t, repetition.MIN_WORDS), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words) == want[:6]
        if t != "word " * 30_000:
            assert r.longest_repeat == want[6]
        else:
            assert r.longest_repeat == 29_999
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed
        assert r.kept == (not failed and r.n_covered_words <= repetition.MAX_FRACTION * r.n_words and r.longest_repeat <= repetition.MAX_REPEAT)
    kept = repetition.keep(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert repetition.measure(docs.limit(0)).count() == 0 and repetition.keep(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, texts):
    words = ALNUM.findall(lower(next(t for t in texts if t and len(t) > 1500)))
    items = [("b", " ".join(words[20:45])), ("a", " ".join(words[30:52]).upper()), ("a", "zz yy"), ("short", " ".join(words[3:6])), ("none", "?!"), ("null", None), (None, " ".join(words[60:75])), ("twin", " ".join(words[20:45]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(lower(text or ""))
        size = min(10, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])].add(name or "")
    for block_words in (decontaminate.BLOCK_WORDS, 20):
        got = {r.doc_id: r for r in decontaminate.scan(docs, bench, block_words=block_words).collect()}
        for i, t in enumerate(texts):
            w, hit, found = ALNUM.findall(lower(t or "")), set(), set()
            for size in {len(k) for k in windows}:
                for j in range(len(w) - size + 1):
                    if tuple(w[j : j + size]) in windows:
                        hit |= set(range(j, j + size))
                        found |= windows[tuple(w[j : j + size])]
            r = got[i]
            assert (r.n_words, r.n_hit, r.items, r.contaminated) == (len(w), len(hit), sorted(found), bool(hit))
            if hit:
                a, n = r.longest_at, r.longest_words
                padded = [(k or "", f" {' '.join(ALNUM.findall(lower(x or '')))} ") for k, x in items]
                assert any(k == r.longest_item and f" {' '.join(w[a : a + n])} " in x for k, x in padded)
                assert not any(f" {' '.join(w[j : j + n + 1])} " in x for j in hit if j + n < len(w) for _, x in padded)
        assert {r.doc_id for r in decontaminate.keep(docs, bench, block_words=block_words).collect() if r.doc_id is not None} == {i for i in range(len(texts)) if not got[i].n_hit}


def test_decontamination_of_windows_that_blocks_share(spark):
    """Items of different blocks that share a window, an item that is that window alone, and short ones: every split gives the same rows."""
    shared = [f"s{i}" for i in range(10)]
    for names in ("abcdefg",):
        items = [(n, " ".join([*[f"{n}{j}" for j in range(k)], *shared, *[f"{n}e{j}" for j in range(k)]])) for k, n in enumerate(names[:5])] + [(names[5], "just three words"), (names[6], " ".join(shared[3:] + ["t1", "t2", "t3"]))]
        documents = [(0, " ".join(["x"] * 30 + shared + ["y"] * 5)), (1, items[4][1]), (2, "just three words"), (3, "just three Words more"), (4, "clean " * 40), (5, None), (6, " ".join(shared + ["t1", "t2", "t3"])), (7, " ".join(shared))]
        docs = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, sets string")
        bench = spark.createDataFrame(items, "item_id string, text string")
        windows = defaultdict(set)
        for name, text in items:
            w = text.split()
            for j in range(max(1, len(w) - 9)):
                windows[tuple(w[j : j + 10])].add(name)
        want = {}
        for i, text in documents:
            w, hit, found = lower(text or "").split(), set(), set()
            for k, own in windows.items():
                for j in range(len(w) - len(k) + 1):
                    if tuple(w[j : j + len(k)]) == k:
                        hit |= set(range(j, j + len(k)))
                        found |= own
            want[i] = (len(w), len(hit), sorted(found), bool(hit))
        for block_words in (10, 25):
            got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.scan(docs, bench, block_words=block_words).collect()}
            assert got == want, block_words
            kept = decontaminate.keep(docs, bench, block_words=block_words)
            assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[3]}
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0
    digest = decontaminate.scan(docs, bench).select("items", decontaminate.items_digest("items").alias("d")).collect()
    assert all(r.d == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() for r in digest)


def test_shared_passages_are_not_spelled_out_in_pairs(spark):
    """300 items and 3000 texts share a passage: as many rows as texts, one set of items."""
    passage = " ".join(f"p{i}" for i in range(14))
    bench = spark.createDataFrame([(f"i{k:03}", f"start {k} {passage} end{k}") for k in range(300)], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"own{k} words {passage} tail") for k in range(3000)], "doc_id long, text string")
    rows = decontaminate.scan(docs, bench).collect()
    assert len(rows) == 3000 and {(r.n_hit, len(r["items"]), r.longest_words, r.longest_at) for r in rows} == {(14, 300, 14, 2)}
    assert decontaminate.keep(docs, bench).count() == 0


def fingerprint_of(s):
    w = SPACE.findall(lower(s or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, texts):
    rows = simhash.linked(docs).collect()
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows}
    prints = [fingerprint_of(t) for t in texts]
    assert len(rows) == len(texts) + 2 and [got[i][0] for i in range(len(texts))] == prints
    roots = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert [got[i][1] for i in range(len(texts))] == roots
    assert got[None] == (prints[5], roots[5])
    assert simhash.linked(docs.limit(0)).count() == 0


def test_anchors_cover_all_links(spark):
    """Fingerprints at every distance, one crowd of them; small blocks, so that crowded anchors are cut."""
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = set(base) | {b ^ sum(1 << x for x in random.sample(range(64), k)) for b in base for k in range(1, 7)}
    crowd = random.getrandbits(64)
    fps |= {crowd ^ sum(1 << x for x in random.sample(range(64), random.randrange(6))) for _ in range(300)}
    fps = sorted(fps)
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for block, share, segments in ((4096, 16, simhash.SEGMENTS), (16, 1, simhash.SEGMENTS), (4096, 16, simhash.WIDE_SEGMENTS)):
        links = [(fps.index(r.a & (2**64 - 1)), fps.index(r.b & (2**64 - 1))) for r in simhash.near_links(nodes, 4, block, share, segments).collect()]
        assert union(len(fps), links) == want


def test_components(spark):
    random.seed(4)
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000, i) for i in range(2001, 2100)]
    links = path + star + [(random.randrange(300), random.randrange(300)) for _ in range(150)] + [(7, 7)]
    ids = {x: i for i, x in enumerate(sorted({x for l in links for x in l}))}
    names = list(ids)
    roots = union(len(ids), [(ids[a], ids[b]) for a, b in links])
    groups = lambda pairs: {frozenset(v) for v in pairs.values() if len(v) > 1}
    want, got = defaultdict(set), defaultdict(set)
    for x, i in ids.items():
        want[roots[i]].add(x)
    for r in components.components(spark.createDataFrame(links, "a long, b long")).collect():
        got[r.root].add(r.node)
    assert groups(want) == groups(got) and names
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(docs, texts):
    cut = 64
    rows = packing.pack(packing.pieces(docs, tokens=cut), tokens=cut).collect()
    raw = WordEncoder.of(tokenizer_path(packing.TOKENIZER)).tokenizer
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(r.ids) // 4
        by_doc[r.doc_id].append((r.piece, r.start, np.frombuffer(bytes(r.ids), dtype="<u4").tolist()))
    for i, t in enumerate(texts):
        if i == 3:
            continue  # stands twice
        want = raw.encode(t or "", add_special_tokens=False).ids + [1]
        assert sorted(by_doc[i]) == [(k, a, want[a : a + cut]) for k, a in enumerate(range(0, len(want), cut))]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= cut
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / cut + 2
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def naive_best_fit(lengths, capacity, weights, rule):
    """Best-fit by plain loops over the open sequences."""
    bins, out = [], []
    for length in lengths:
        need, best = (length, 1, length * length), None
        for k, free in enumerate(bins):
            if all(f >= x for f, x in zip(free, need)):
                norm = sum(w * ((f - x) / c) ** 2 for w, f, x, c in zip(weights, free, need, capacity))
                dot = sum(w * f * x / c**2 for w, f, x, c in zip(weights, free, need, capacity))
                score = norm if rule == "norm" else dot
                if best is None or score < best[0] - 1e-12:
                    best = (score, k)
        if best is None:
            bins.append(list(capacity))
            best = (0, len(bins) - 1)
        bins[best[1]] = [f - x for f, x in zip(bins[best[1]], need)]
        out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    """Capacities that all bind, against plain loops."""
    random.seed(5)
    lengths = np.array(sorted((random.randrange(1, 100) for _ in range(500)), reverse=True))
    sequence, offset = packing.packed(lengths, (100, 5, 4000), (1.0, 0.5, 0.5), rule)
    assert sequence.tolist() == naive_best_fit(lengths.tolist(), (100, 5, 4000), (1.0, 0.5, 0.5), rule)
    sizes = [lengths[sequence == k] for k in set(sequence.tolist())]
    assert any(len(x) == 5 for x in sizes) and any((x**2).sum() > 3500 for x in sizes) and any(x.sum() > 95 for x in sizes)
    for k in set(sequence.tolist()):
        own = lengths[sequence == k]
        assert own.sum() <= 100 and len(own) <= 5 and ((own**2).sum() <= 4000 or len(own) == 1)
        assert offset[sequence == k].tolist() == (np.cumsum(own) - own).tolist()


def test_packing_without_ids(spark):
    """50,000 rows without an id are spread like any others, and fill their sequences."""
    docs = spark.range(50_000, numPartitions=5).selectExpr("cast(null as long) as doc_id", "concat('some words ', id % 97) as text")
    rows = packing.pack(packing.pieces(docs, with_ids=False), shard_pieces=4096).selectExpr("sequence_id", "shiftright(sequence_id, 32) as shard", "length").toPandas()
    assert len(rows) == 50_000 and rows.groupby("shard").size().max() < 5000
    assert rows.sequence_id.nunique() <= rows.length.sum() / 4096 + 2 * rows.shard.nunique()


def test_word_encoder_equals_the_tokenizer():
    encoder = WordEncoder.of(tokenizer_path(packing.TOKENIZER))
    odd = ["Don't stop<|endoftext|>x Straße İstanbul ΑΣ é 3.4 foo\x1cbar x <|STARTOFTEXT|> ªº µ ŉ don’t", "ÇA va, Élan. ÀB3 x_y", "", " \n", None, "日本語 テキスト, ok."]
    want = [np.array(encoder.tokenizer.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in odd]
    assert encoder.encode(odd) == want and encoder.encode(odd) == want


def test_token_spans(docs, texts):
    for rule in ("first", "last", "most"):
        rows = defaultdict(list)
        for r in token_spans.line_tokens(docs.where("doc_id is null or doc_id <> 3"), rule=rule).collect():
            rows[r.doc_id].append(r)
        encoding, lengths = token_spans.encoder(tokenizer_path(token_spans.VOCABULARY))
        for i, t in enumerate(texts):
            if i == 3:
                continue
            t = t or ""
            parts, own = re.findall(r"[^\n]*\n|[^\n]+$", t) or [""], sorted(rows[i], key=lambda r: r.section)
            assert [t[r.start : r.end] for r in own] == parts
            ids = encoding.encode_ordinary(t)
            assert sum(r.n_tokens for r in own) == len(ids)
            bounds, at, want = np.cumsum([0] + [len(p.encode()) for p in parts]), 0, [0] * len(parts)
            for n in lengths[np.array(ids, dtype=int)]:
                shares = [max(0, min(at + n, bounds[k + 1]) - max(at, bounds[k])) for k in range(len(parts))]
                there = [k for k, s in enumerate(shares) if s > 0]
                want[there[0] if rule == "first" else there[-1] if rule == "last" else int(np.argmax(shares))] += 1
                at += n
            assert [r.n_tokens for r in own] == want
    assert token_spans.line_tokens(docs.limit(0)).count() == 0


def test_field_tokens(spark):
    """Owners of every character by brute force; overlaps, gaps, empty and null fields."""
    rows = [(1, "Title here\nBödy of the text, which goes on.", [("title", 0, 10), ("body", 11, 20), ("over", 15, 30), ("none", 40, 40)]), (2, "no fields", None), (3, None, [("a", 0, 5)]), (4, "all of it", [("all", 0, 99)]), (None, "", [])]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fields array<struct<name:string,start:long,end:long>>, field string")
    encoding, lengths = token_spans.encoder(tokenizer_path(token_spans.VOCABULARY))
    for rule in ("first", "last", "most"):
        got = defaultdict(dict)
        for r in token_spans.field_tokens(docs, rule=rule).collect():
            got[r.doc_id][r.field] = r.n_tokens
        for i, t, fields in rows:
            t, fields = t or "", fields or []
            owner = [next((f[0] for f in sorted(fields, key=lambda f: f[1]) if f[1] <= k < f[2]), None) for k, c in enumerate(t) for _ in c.encode()]
            want, at = Counter({f[0]: 0 for f in fields}), 0
            for n in lengths[np.array(encoding.encode_ordinary(t), dtype=int)]:
                own = owner[at : at + n]
                runs = [(k, len(list(g))) for k, g in itertools.groupby(own)]
                want[own[0] if rule == "first" else own[-1] if rule == "last" else max(runs, key=lambda x: x[1])[0]] += 1
                at += n
            assert got[i] == (dict(want) or {None: 0})
    assert token_spans.field_tokens(docs.limit(0)).count() == 0


def test_html(spark):
    page = lambda title, extra="": f"<html><head><title>t</title><script>if(a<b)x('</p>')</script></head><body><header>Head</header><nav><ul><li>Home<li>About</ul></nav>{extra}<article><header><h1>{title}</h1></header><p>One &amp; <b>two</b>&nbsp;x<p>{title} three<div class='share-box'>Share</div><!-- no > --></article><aside>Side</aside><div id=comments><p>Nice</div><footer>&copy;</footer></body>"
    plain = lambda own: f"<body><div>Welcome</div><div>{own} tells</div><p>{own} more</p><form><input>Go</form><div>Legal line</div></body>"
    rows = [
        (1, "http://a.b/x/1", page("First")), (2, "http://a.b/x/2", page("Second")), (3, "http://p.q/1", plain("Ann")), (4, "http://p.q/2", plain("Bob")), (5, "http://p.q/3?x", plain("Cy")),
        (6, "http://same.z/1", plain("Dup")), (7, "http://same.z/2", plain("Dup")), (8, None, None), (9, "odd", ""), (10, "http://c.d/", "<p>only"), (11, "http://c.e/", "<body"), (2, "http://a.b/x/2", page("Second")),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_diff.extract(pages).collect()}
    assert got[1] == "First One & two x First three" and got[2] == "Second One & two x Second three"
    assert (got[3], got[4], got[5]) == ("Ann tells Ann more", "Bob tells Bob more", "Cy tells Cy more")
    assert got[6] == got[7] == "Welcome Dup tells Dup more Legal line"  # a host of copies alone
    assert (got[8], got[9], got[10]) == ("", "", "only")
    assert html_diff.extract(pages).count() == len(rows) and html_diff.extract(pages.limit(0)).count() == 0


def test_html_marks():
    """Quotes inside unquoted values, headlines in content, data attributes, hidden elements."""
    text = lambda page: " ".join(x for r, x in html_diff.lines_of(page) if r != html_diff.BOILERPLATE)
    assert text("<p title=it's>One</p><p>Two's</p>") == "One Two's"
    assert text('<article><header class="entry-header"><h1>Head</h1></header><div class="article-header">Sub</div><p>Body</article>') == "Head Sub Body"
    assert text('<p data-id="search">Kept</p><div id="search">Gone</div><div class="search-results-story">Kept too</div>') == "Kept Kept too"
    assert text('<p hidden>a</p><p aria-hidden="true">b</p><div style="color:red; display: none"><p>c</p></div><p aria-hidden=false>d</p>') == "d"
    assert text('<p class="x" title="a > b">in</p><a href=/x/>link</a> tail<p class=" =unclosed>rest') == "in link tail rest"
    assert text("<p x=" + "='" * 20_000 + ">long") == "long"


def naive_page(lines, neighbours):
    """The open lines that no template has: by plain LCS with the nearest neighbour on either side that is no copy."""
    keep = [True] * len(lines)
    for side in neighbours:
        for other in side:
            t = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
            for i in range(len(lines) - 1, -1, -1):
                for j in range(len(other) - 1, -1, -1):
                    t[i][j] = t[i + 1][j + 1] + 1 if lines[i] == other[j] else max(t[i + 1][j], t[i][j + 1])
            i = j = 0
            both = set()
            while i < len(lines) and j < len(other):
                if lines[i] == other[j]:
                    both.add(i)
                    i, j = i + 1, j + 1
                elif t[i + 1][j] >= t[i][j + 1]:
                    i += 1
                else:
                    j += 1
            if len(both) < len(lines):
                keep = [k and n not in both for n, k in enumerate(keep)]
                break
    return " ".join(x for x, k in zip(lines, keep) if k)


def test_html_articles_are_not_hidden():
    """Forms and class words above an article, class words that only contain a mark, blocks that close a paragraph, forms around a page."""
    text = lambda page: " ".join(x for r, x in html_diff.lines_of(page) if r != html_diff.BOILERPLATE)
    assert text('<form id="aspnetForm"><div class="no-sidebar"><article>A <p>text</p><form>box</form></article></div></form>') == "A text"
    assert text('<div id="content-with-banner"><article>B</article></div>') == text('<div class="sidebar"><main>B</main></div>') == "B"
    assert text('<article><p class="share-price">D1</p><p class="cookie-recipe">D2</p><div class="ad-hoc">D3</div><p id="share">D4</p><div class="related-posts">no</div><div id="reply-list">no</div></article>') == "D1 D2 D3 D4"
    assert text('<article><p class="ad">Buy<div>Real text</div></article>') == "Real text"
    assert text('<article><p class="ad">Buy<h2>Real heading</h2>x</article>') == "Real heading x"
    assert text("<article>main<p>t</article><div class='comments'><article>c</article></div>") == "main t"
    assert text('<ul><li class="ad">x<ul><li>y</ul>z<li>w</ul>') == "w"
    prose = "word " * 30
    assert text(f"<form><p>{prose}</p><input></form><div>menu</div>") == f"{prose}menu"
    assert text("<form>Go</form><div>text of the page</div>") == "text of the page"
    assert text("<svg/>q<SCRIPT>if(a<b)</SCRIPT >r<!-- x") == "q r" and text("a < b and <3 <b>c</b> d <") == "a < b and <3 c d <"


def test_html_is_read_in_linear_time():
    """300 KB of unclosed tags, quotes, comments and elements."""
    for unit in ("<script ", "<a ", "<b>x</i>", '<p class="', "<a b='\">", "<!-", "<!--", "<style>", "</x", "<a =", "<div><p>", "<li>", "<svg ", '<a b=" > " c="<a >" '):
        began = time.process_time()
        html_diff.lines_of(unit * (300_000 // len(unit)))
        assert time.process_time() - began < 3, unit


def test_html_against_plain_differencing(spark):
    """Hosts of unmarked pages with more template lines than text, and copies next to one another."""
    random.seed(10)
    rows = []
    for h in range(6):
        template = [f"menu{h} {k}" for k in range(20)]
        for k in range(12):
            own = [f"host {h} page {k} paragraph {i} of text" for i in range(random.randrange(1, 9))]
            if k in ((5, 6) if h else range(2, 11)):
                own = [f"host {h} copied paragraph {i} of text" for i in range(5)]
            if h == 1 and 2 <= k <= 10:  # each page has all lines of the one before
                own = [f"host {h} nested paragraph {i} of text" for i in range(k)]
            if h == 2 and k in (3, 4):  # short own texts in a large template
                own = [f"paragraph {k}"]
            rows.append((f"http://h{h}.x/p/{k:02}", template[:15] + own + template[15:]))
    pages = spark.createDataFrame([(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, (u, lines) in enumerate(rows)], "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html_diff.extract(pages).collect()}
    for i, (u, lines) in enumerate(rows):
        host = [x for v, x in rows if v[:11] == u[:11]]
        k = i % 12
        want = naive_page(lines, [[host[j] for j in range(k - 1, -1, -1)], [host[j] for j in range(k + 1, 12)]])
        assert got[i] == want and "menu" not in want and "paragraph" in want


def test_html_pages_with_articles_are_differenced(spark):
    """Teasers and bars that only differencing tells go, quotes in an article stay, copies are passed over; in large and in small batches."""
    def page(own, extra="", bar="", menu="Menu"):
        return f"<nav>{menu}</nav><div>Loose</div><main>{bar}<article>{own}</article>{extra}</main><footer>Foot</footer>"

    teaser, bar = "<article class=teaser><h2>Latest</h2><p>News of the house</article>", "<div>You are here</div>"
    rows = [
        page("<p>A one<p>Quote", teaser, bar), page("<p>B one<p>Quote<p>B two", teaser, bar),
        *[page("<p>C one<p>C two", teaser, bar, menu=f"M{k}") for k in range(7)], page("<p>D one", "", bar), page("<p>D one<p>Quote", "<article>Own news</article>", "<div>Own bar</div>"),
    ]
    want = ["A one Quote", "B one Quote B two", *["C one C two"] * 7, "D one", "Own bar D one Quote Own news"]
    pages = spark.createDataFrame([(k, f"http://a.b/{k:02}", x) for k, x in enumerate(rows)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10000", "2"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = {r.page_id: r for r in html_diff.extract(pages.repartition(3)).collect()}
            assert [got[k].text for k in range(len(rows))] == want
            # Shared by 0 and 1: menu, loose line, bar, quote, teaser, footer; only the quote is given back.  The crowd's menus are its own.
            assert [(got[k].n_lines, got[k].n_shared, got[k].n_restored) for k in (0, 1, 4)] == [(8, 7, 1), (9, 7, 1), (8, 5, 0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_html_near_copies_leave_a_page_its_text(spark):
    """A near copy on one side and the template with the rest on the other: what only the near copy shares stays."""
    page = lambda date, own: f"<div>Welcome</div><div>{date}</div><p>{own} one</p><p>{own} two</p><div>Legal</div>"
    article = lambda own, teaser: f"<article>{own}</article><article>{teaser}</article>"
    rows = [("p.q/1", page("May", "Ann")), ("p.q/2", page("May", "Bob")), ("p.q/3", page("June", "Bob")), ("r.s/1", article("Cy", "News")), ("r.s/2", article("Di<p>tells", "News")), ("r.s/3", article("Di<p>tells", "Old"))]
    pages = spark.createDataFrame([(k, f"http://{u}", x) for k, (u, x) in enumerate(rows)], "page_id long, url string, html string")
    for n in (1, 4):
        got = {r.page_id: r.text for r in html_diff.extract(pages.repartition(n)).collect()}
        assert (got[1], got[4]) == ("Bob one Bob two", "Di tells")


def test_lcs():
    random.seed(6)
    for _ in range(300):
        a, b = ([random.randrange(5) for _ in range(random.randrange(14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        own = html_diff.shared(np.array(a, dtype=int), np.array(b, dtype=int))
        left = iter(b)
        assert own.sum() == t[0][0] and all(x in left for x, k in zip(a, own) if k)


def test_tool_links(spark):
    schemas = {"get": {"properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer"}}, "required": ["q"]}}
    chain = [("c", f"k{i}", f"k{i - 1}" if i else None, "get", f'{{"q":"é{i}", "n":{i}}}') for i in range(40)]
    odd = [
        ("c", "p1", None, "get", "no json"), ("c", "p2", None, "get", '{"n":1}'), ("c", "p3", None, "get", '{"q":"a","n":true}'), ("c", "p4", None, "get", '{"q":"a","z":1}'), ("c", "p5", None, "put", "{}"),
        ("c", "y1", "y2", "get", '{"q":"a"}'), ("c", "y2", "y1", "get", '{"q":"a"}'), ("c", "m1", "gone", "get", '{"q":"a"}'), ("c", "d1", None, "get", '{"q":"b"}'), ("c", "d1", None, "get", '{"q":"a"}'), (None, None, None, None, None), ("c", "e", None, "get", None),
    ]
    calls = spark.createDataFrame(chain + odd, "conv_id string, call_id string, parent_id string, name string, arguments string")
    results = spark.createDataFrame([(f"k{i}", f"r{i}") for i in range(39)] + [("k0", "a"), ("stray", "x"), (None, "y"), ("d1", None)], "call_id string, content string")
    got = {r.call_id: r for r in tool_links.link(calls, results, schemas).collect()}
    assert [got[f"k{i}"].level for i in range(40)] == list(range(40))
    assert [got[f"k{i}"].status for i in range(40)] == ["linked"] * 39 + ["no result"]
    assert got["k0"].n_results == 2 and got["k0"].canonical == '{"arguments":{"n":0,"q":"é0"},"id":"k0","name":"get","parent":null,"result":"a"}'
    assert {k: (got[k].status, got[k].error) for k in ("p1", "p2", "p3", "p4", "p5", "y1", "y2", "m1", "stray", "e")} == {
        "p1": ("unparsed", None), "p2": ("invalid", "q: missing"), "p3": ("invalid", "n: not integer"), "p4": ("invalid", "z: unknown"), "p5": ("unknown tool", None),
        "y1": ("cycle", None), "y2": ("cycle", None), "m1": ("missing parent", None), "stray": ("orphan", None), "e": ("unparsed", None),
    }
    assert '"q":"a"' in got["d1"].canonical and got[None].status == "orphan"
    assert tool_links.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_tool_arguments():
    """What has no canonical JSON is unparsed, and nested schemas are checked to the bottom."""
    bad = ['{"q":' + "[" * 100_000, '{"q":"\\ud800"}', '{"q":NaN}', '{"q":1e999}', '{"q":1,"q":2}', "[1]", "", None, '{"q":' + "[" * 200 + "]" * 200 + "}"]
    assert [tool_links.parsed(x) for x in bad] == [None] * len(bad) and tool_links.parsed('{"q":"[[{\\"","z":[{}]}') == {"q": '[[{"', "z": [{}]}
    rule = {"properties": {"a": {"type": "array", "maxItems": 2, "items": {"type": "object", "properties": {"n": {"type": "number", "minimum": 0, "maximum": 9}, "s": {"type": "string", "pattern": "^x"}}, "required": ["n"]}}}}
    for value, want in (({"a": [{"n": 1, "s": "xy"}]}, None), ({"a": [{"n": 1}, {"n": 10}]}, "a[1].n: bounds"), ({"a": [{}]}, "a[0].n: missing"), ({"a": [{"n": 1, "s": "y"}]}, "a[0].s: pattern"), ({"a": [1]}, "a[0]: not object"), ({"a": [{"n": 1}] * 3}, "a: items")):
        assert tool_links.schema_error(value, rule) == want


def test_schema_rules():
    """Types in a list, const, alternatives, references, JSON equality."""
    schema = {
        "$defs": {"size": {"type": ["integer", "null"], "minimum": 0}, "tree": {"type": "object", "properties": {"next": {"$ref": "#/$defs/tree"}, "v": {"$ref": "#/$defs/size"}}}},
        "properties": {
            "n": {"$ref": "#/$defs/size"}, "kind": {"const": "a"}, "flag": {"enum": [1, "x"]}, "either": {"anyOf": [{"type": "string", "minLength": 3}, {"type": "boolean"}]}, "one": {"oneOf": [{"type": "number"}, {"type": "integer"}]},
            "all": {"allOf": [{"type": "number"}, {"maximum": 5}]}, "tree": {"$ref": "#/$defs/tree"}, "open": {"type": "object", "properties": {}, "additionalProperties": {"type": "integer"}},
        },
    }
    check = lambda **v: tool_links.schema_error(v, schema)
    assert check(n=None) is None and check(n=3) is None and check(n=True) == "n: not integer or null" and check(n=-1) == "n: bounds" and check(n="x") == "n: not integer or null"
    assert check(kind="a") is None and check(kind="b") == "kind: not const" and check(flag=1.0) is None and check(flag=True) == "flag: not in enum"
    assert check(either=True) is None and check(either="abc") is None and check(either="ab") == "either: none of anyOf"
    assert check(one=1.5) is None and check(one=1) == "one: not one of oneOf" and check(all=4) is None and check(all=6) == "all: bounds"
    assert check(tree={"next": {"next": {"v": 2}}}) is None and check(tree={"next": {"next": {"v": "2"}}}) == "tree.next.next.v: not integer or null"
    assert check(open={"a": 1}) is None and check(open={"a": "b"}) == "open.a: not integer"
    with pytest.raises(ValueError, match="nowhere"):
        tool_links.schema_error({"a": 1}, {"properties": {"a": {"$ref": "#/x"}}, "x": {"$ref": "#/x"}})
    assert tool_links.parsed('{"a":' * 150 + "1" + "}" * 150) is None and tool_links.parsed('{"a":' * 150 + "1" + "}" * 150, 200) is not None


def test_several_parents(spark):
    """Levels are longest ways, against plain recursion; a third of the calls continue from one."""
    random.seed(9)
    edges = {(f"n{i}", f"n{random.randrange(i)}") for i in range(1, 60) for _ in range(random.randrange(3))} | {(f"h{i}", "n7") for i in range(40)} | {("n0", "zz"), ("y1", "y2"), ("y2", "y1"), ("y3", "y1"), ("y3", "n5")}
    names = sorted({a for a, _ in edges} | {b for _, b in edges} - {"zz"})
    up = defaultdict(list)
    for a, b in edges:
        if b != "zz":
            up[a].append(b)
    level = lambda x: 1 + max(level(p) for p in up[x]) if up[x] else 0
    calls = spark.createDataFrame([("c", x, None, "get", "{}", 1) for x in names], "conv_id string, call_id string, parent_id string, name string, arguments string, level int")
    parents = spark.createDataFrame(sorted(edges), "call_id string, parent_id string")
    for ordered in (tool_links.ORDERED, 5):  # in a task, and in rounds over tables
        got = {r.call_id: r for r in tool_links.link(calls, spark.createDataFrame([], "call_id string, content string"), {"get": {}}, parents, ordered=ordered).collect()}
        assert {x: got[x].level for x in names} == {x: None if x[0] == "y" else level(x) for x in names}
        assert got["n0"].status == "missing parent" and got["y3"].status == "cycle" and got["n1"].status == "no result"


def test_deep_conversations(spark):
    """Conversations whose every call continues from the two before it: as many rounds as for shallow ones."""
    calls = spark.range(20 * 300).selectExpr("concat('c', id div 300) AS conv_id", "concat(id div 300, ':', id % 300) AS call_id", "if(id % 300 > 0, concat(id div 300, ':', id % 300 - 1), null) AS parent_id", "'get' AS name", "'{}' AS arguments")
    parents = spark.range(20 * 300).where("id % 300 > 1").selectExpr("concat(id div 300, ':', id % 300) AS call_id", "concat(id div 300, ':', id % 300 - 2) AS parent_id")
    found = tool_links.link(calls, spark.createDataFrame([], "call_id string, content string"), {"get": {}}, parents)
    assert found.where("level = cast(split(call_id, ':')[1] AS long)").count() == 20 * 300


def test_licenses(spark):
    mit = licenses._MIT
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE")), (2, "text\nReleased under the MIT LICENCE\nmore"), (3, None), (4, " ,. "), (5, mit + " and more"), (6, "Licensed under CC BY-NC 4.0."),
        (6, "Licensed under CC BY-NC 4.0."), (None, "All rights reserved."), (7, "© 2021 X\nLicensed under the Apache Licence, version 2.0\nAll rights reserved."),
    ]
    docs = spark.createDataFrame([(*r, "z", "y") for r in rows], "doc_id long, text string, license string, digest string")
    got = sorted(((r.doc_id or 0, r.license, r.n_license_lines, r.line_licenses) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted([(1, "MIT", 0, ""), (2, None, 1, "MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (6, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (6, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (0, "LicenseRef-all-rights-reserved", 1, "LicenseRef-all-rights-reserved"), (7, None, 2, "Apache-2.0,LicenseRef-all-rights-reserved")], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def brute_probability(counts, context, c, alphabet):
    """Interpolated Kneser-Ney by dictionaries; counts: grams of 4 symbols."""
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    p = 1 / (alphabet + 1.0)
    for n in range(1, 5):
        level, ctx = levels[n], context[len(context) - (n - 1) :] if n > 1 else ""
        once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
        own = {g: v for g, v in level.items() if g[:-1] == ctx}
        if own:
            total = sum(own.values())
            p = max(own.get(ctx + c, 0) - d, 1e-9 if ctx + c in own else 0) / total + d * len(own) / total * p
    return p


def test_license_texts_in_their_usual_wrapping(spark):
    """Lines that begin with the word copyright but are no notice stay; notices of several forms go; spellings across lines are one."""
    import textwrap

    isc = licenses._ISC.replace("provided that the above copyright", "provided that the above\ncopyright")
    bsd = "Copyright 2019-2021 The Authors. All rights reserved.\n\n" + "\n".join("\n".join(textwrap.wrap(x, 72)) for x in (licenses._BSD2 + licenses._BSD).replace("the above copyright", "the above\ncopyright").split("\n"))
    rows = [
        (1, "ISC License\n\nCopyright (c) 4-digit-year, Company\n" + isc), (2, bsd), (3, "Copyright <YEAR> <COPYRIGHT HOLDER>\n" + licenses._MIT), (4, "  * Copyright by Foo\n  * (c) 1999 Bar\n" + licenses._MIT.replace("\n", "\n  * ")),
        (5, "Copyright notice first.\n" + licenses._MIT), (6, licenses._BSD2 + licenses._BSD3.replace("copyright holder", "copyright\nowner") + licenses._BSD),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: "ISC", 2: "BSD-2-Clause", 3: "MIT", 4: "MIT", 5: None, 6: "BSD-3-Clause"}
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == want

    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert {r[0]: r[1] for r in con.execute(f"select doc_id, license from ({licenses.oracle_sql()})").fetchall()} == want


def test_long_licenses_by_their_digests(spark):
    """Whole texts of the system's common licences, reflowed, quoted as a comment and behind a notice, in Spark and SQL; a changed word is no licence."""
    import textwrap

    import duckdb

    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl", "GFDL-1.3": "GFDL-1.3-only"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files):
        pytest.skip("no folder of common licences")
    rows, want = [], {}
    for f, name in files.items():
        with open(f"{folder}/{f}") as file:
            text = file.read()
        end = text.find("END OF TERMS AND CONDITIONS")
        notice, paragraphs = "Copyright (c) 2021 Someone <a@b.c>\n\n", re.split(r"\n[ \t]*\n", text)
        forms = [text, notice + text, textwrap.indent(text, " * ", lambda _: True).upper()]
        if not re.search(r"(?i)copyright (\(c\)|\[)", text):  # a notice ends with its line, so texts that hold one are not reflowed
            forms.append("\n\n".join(textwrap.fill(x, 100) for x in paragraphs))
        forms += [text[: end + 27]] if end >= 0 else []
        for x in forms:
            want[len(rows)] = name
            rows.append((len(rows), x))
        want[len(rows)] = None
        rows.append((len(rows), text.replace(" shall ", " need ", 1).replace(" may ", " might ", 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs).collect()} == want
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert {r[0]: r[1] for r in con.execute(f"select doc_id, license from ({licenses.oracle_sql()})").fetchall()} == want
    known = {(name, digest) for name, _, digest in licenses.KNOWN_DIGESTS}
    assert len(known) == len(licenses.KNOWN_DIGESTS) == len({digest for _, digest in known})


def test_language_symbols(spark):
    """Marks and emoji alone are no words; letters beyond U+FFFF are not taken for others."""
    found = lambda *texts: langid.Words(pa.array(texts))
    assert len(found("\u2600\ufe0f 12", "\u0301 !", "\U0001f600\u200d", "").size) == 0
    assert len(found("ab", "\U00020061\U00020062", "a\u0301b").size) == 3
    words = found("\U00020061 \U00020062 \U00020061")
    assert sorted(words.size.tolist()) == [2, 2] and len(words.text) == 3
    docs = spark.createDataFrame([(0, "ab ab ab", "x"), (1, "\U00020061\U00020062 \U00020061\U00020062", "y"), (2, "\u2600\ufe0f 12", None), (3, "ab", None), (4, "\U00020061\U00020062", None), (5, "\u0301\u0302", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(False), "doc_id").collect()}
    assert (got[2], got[3], got[4], got[5]) == ("und", "x", "y", "und")


def test_language_model(spark):
    rows = [(0, "banana bandana an", "x"), (1, "nab Ban", "x"), (2, "o10 zoo oz", "y")]
    docs = spark.createDataFrame(rows + [(3, None, "x"), (4, "!?", "y"), (5, "other", None)], "doc_id long, text string, lang string")
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        for w in re.findall("[^\\W\\d_]+", t.lower()):
            s = "   " + " " + w + " "
            counts[lang].update(s[i - 3 : i + 1] for i in range(4, len(s)))
    alphabet = len({g[-1] for c in counts.values() for g in c})
    texts = spark.createDataFrame([(0, "ban zoo"), (1, "q"), (2, "")], "doc_id int, text string")
    for stored in (langid.STORED, 20, 0):  # all, the frequent or no keys are broadcast, the others joined
        model = langid.fit(docs.where("lang is not null and text is not null"), stored=stored)
        assert model.alphabet == alphabet and model.whole == (stored > 20)
        got = {r.doc_id: r for r in langid.totals(texts, model, "text", ["doc_id"]).collect()}
        for k, lang in enumerate(model.languages):
            total = sum(np.log(brute_probability(counts[lang], s[i - 3 : i], s[i], alphabet)) for w in ("ban", "zoo") for s in ["    " + w + " "] for i in range(4, len(s)))
            assert abs(got[0].total[k] - total) < 1e-3
        assert [got[i].size for i in range(3)] == [8, 2, 0]
    got = {r.doc_id: r for r in langid.identify(docs, F.col("doc_id") == 2, "doc_id").collect()}
    assert got[0].lang_pred == "x" and got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[2].held_out
    assert {r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(False)).count() == 0


def test_language_thresholds_are_of_all_training_documents(spark):
    """2600 documents in one language and three in another, equal ones among them: rejected is what the exact quantiles say."""
    random.seed(3)
    word = lambda letters: "".join(random.choice(letters) for _ in range(random.randrange(1, 7)))
    rows = [(k, " ".join(word("abcdefgh" if k % 100 else "ghijklmnopq") for _ in range(random.randrange(1, 12))), "x") for k in range(2600)]
    rows += [(3000 + k, "hagede", "x") for k in range(40)] + [(4000, "\u03b1\u03b2\u03b3", "y"), (4001, "\u03b2\u03b1", "y"), (4002, "\u03b3\u03b3\u03b3\u03b1", "y")]
    rows += [(5000, "\u03b3\u03b2\u03b3\u03b2\u03b2\u03b2", None), (5001, "qpq gag", None), (5002, "?", None), (5003, "\u03b1\u03b1\u03b1\u03b1\u03b2\u03b2", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang, train = {k: x for k, _, x in rows}, docs.where("doc_id < 5000")
    model = langid.fit(train)
    entropy = {r.doc_id: [-t / r.size for t in r.total] if r.size else None for r in langid.totals(docs, model, "text", ["doc_id"]).collect()}
    own = {name: [entropy[k][i] for k in lang if k < 5000 and lang[k] == name] for i, name in enumerate(model.languages)}
    accept = {name: np.quantile(x, 1 - langid.QUANTILE) for name, x in own.items()}
    found = langid.identify(docs, F.col("doc_id") >= 5000).collect()
    assert len(found) == len(rows) and sum(r.rejected for r in found if r.lang_pred == "x") >= 20
    assert {r.doc_id for r in found if r.rejected} == {k for k, x in entropy.items() if x is None or min(x) > accept[model.languages[int(np.argmin(x))]]}
    model.accept[:] = np.inf
    langid.calibrate(model, langid.scored(train, model, "text", ["lang"], "lang"))
    assert np.allclose(model.accept, [accept[name] for name in model.languages], rtol=1e-12)


def test_many_languages(spark):
    """70 of them, each with letters of its own, and marks on letters that belong to their words."""
    rows = [(k, "".join(chr(0x4E00 + 50 * k + i % 7) for i in range(30)), f"l{k:02}") for k in range(70)] + [(70, "\u0928\u092e\u0938\u094d\u0924\u0947 " * 3, "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == dict((a, c) for a, _, c in rows)[r.doc_id] for r in langid.identify(docs, F.lit(False)).collect())
    assert len(langid.Words(pa.array([rows[-1][1]])).size) == 1


def test_stored_keys_change_no_prediction(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = [sorted((r.doc_id, r.lang_pred, round(r.score, 5), r.rejected) for r in langid.identify(docs, F.col("doc_id") % 4 == 2, stored=n).collect()) for n in (langid.STORED, 3000)]
    assert some[0] == some[1]


def test_language_held_out_accuracy(spark, sf_dir):
    found = queries.op9_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count() > 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.choice(3, 20_000, p=[0.7, 0.2, 0.1])
    bad = np.array([[0.02, 0.05, 0.01, 0.03, 0.02, 0.04, 0.01, 0.02], [0.7, 0.6, 0.8, 0.5, 0.6, 0.5, 0.01, 0.02], [0.03, 0.05, 0.02, 0.03, 0.02, 0.04, 0.7, 0.8]])
    votes = np.where(rng.random((len(truth), 8)) < bad[truth], weak_labels.BAD, weak_labels.GOOD)
    patterns, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, chance = weak_labels.em(patterns, count.astype(float), np.full(len(patterns), weak_labels.UNKNOWN))
    assert np.abs(share - [0.7, 0.2, 0.1]).max() < 0.02 and np.abs(chance[:, :, weak_labels.BAD].T - bad).max() < 0.06
    log = np.log([0.7, 0.2, 0.1]) + np.where(votes[:, None, :] == weak_labels.BAD, np.log(bad), np.log(1 - bad)).sum(axis=2)
    best = (log.argmax(axis=1) == truth).mean()  # what knowing the accuracies would give
    assert (posterior[inverse.ravel()].argmax(axis=1) == truth).mean() > best - 0.01


def plain_votes(s, marked, beginnings):
    s = s or ""
    raw, spaced, low = s.encode(), SPACE.findall(s), [w.encode() for w in ALNUM.findall(lower(s))]
    size, n = max(len(raw), 1), len(spaced)
    upper, small = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    symbols = sum(chr(b) in "#*$%&|<>!_=~^{}[]\\" for b in raw) / size
    ends = sum(w[-1] in ".!?" for w in spaced)
    repeats = sum(a == b for a, b in zip(low, low[1:])) / max(len(low), 1)
    phrases = sum(c - 1 for c in Counter(zip(low, low[1:], low[2:])).values()) / max(len(low), 1)
    shout, per_sentence = upper / max(upper + small, 1), n / max(ends, 1)
    vote = lambda bad, good: weak_labels.BAD if bad else weak_labels.GOOD if good else weak_labels.NOTHING
    return [
        vote(n == 0, n >= 50), vote(shout > 0.3 and n >= 3, shout < 0.15), vote(symbols > 0.02, symbols < 0.005), vote(repeats > 0.1, repeats < 0.03), vote(phrases > 0.3, phrases < 0.1),
        vote(per_sentence > 60 and n >= 60, ends > 0 and per_sentence < 30), vote(any(w.decode() in weak_labels.INSULTS for w in low), False), vote(any(w in marked or len(w) > 4 and w[:4] in beginnings for w in low), False),
    ]


def test_votes_and_scores(texts):
    texts = texts + ["You IDIOT! Such TRASH.", "SHOUTING ALL DAY LONG", "go go go go now", "{[#]} <|> ok", ". ".join(["one two three"] * 30), " ".join(f"w{i}" for i in range(90))]
    words = sorted({w for t in texts for w in ALNUM.findall(lower(t or ""))}, key=lambda w: hashlib.sha256(w.encode()).digest())
    marked, longer = {w.encode() for w in words[:15]}, [w for w in words[15:60] if len(w.encode()) > 4]
    beginnings = {w.encode()[:4] for w in longer[:10]}
    of = lambda w: weak_labels.Features(pa.array([w]), np.empty(0, dtype=np.uint64))
    marks = np.unique(np.concatenate([*[of(w.decode()).code for w in marked], *[of(w).begin for w in longer[:10]]]))
    found = weak_labels.Features(pa.array(texts, pa.string()), marks)
    assert found.votes.tolist() == [plain_votes(t, marked, beginnings) for t in texts]
    assert {v for row in found.votes.T for v in set(row.tolist())} == {weak_labels.BAD, weak_labels.GOOD, weak_labels.NOTHING} and (found.votes == weak_labels.BAD).any(axis=0).all()

    weights = np.random.default_rng(3).normal(size=3 * len(weak_labels.LABELLERS) + (1 << weak_labels.HASH_BITS))
    column = {w: of(w).word_columns()[0] for w in words}
    got = weak_labels.Scorer(marks, weights, 0.2, None).scores(pa.array(texts, pa.string()))
    for t, score, votes in zip(texts, got, found.votes.tolist()):
        low = ALNUM.findall(lower(t or ""))
        total = sum(weights[3 * j + v] for j, v in enumerate(votes)) + sum(weights[column[w]].sum() for w in low) / max(len(low), 1) + 0.2
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-9)


def test_marks(spark):
    """Marks against counts in plain Python: shares over rows of different texts, and a repeated row counts once."""
    draw = random.Random(5)
    rows = [(i, " ".join([draw.choice(["vilest", "fine"]) if i % 4 else "vilest", *(f"word{draw.randrange(400)}" for _ in range(12))]), i % 4 == 0) for i in range(400)]
    rows = [(i, t.replace("vilest", "decent") if not bad else t, bad) for i, t, bad in rows]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[0][:2]] * 50, "doc_id long, text string")
    found = weak_labels.toxic_marks(docs, spark.createDataFrame([(i, bad) for i, _, bad in rows], "doc_id long, bad boolean"), "text", "doc_id")
    of = lambda w: weak_labels.Features(pa.array([w]), np.empty(0, dtype=np.uint64))
    want = set()
    for cut, code in ((lambda w: w, lambda w: of(w).code[0]), (lambda w: w[:4] if len(w) > 4 else None, lambda w: of(w + "x").begin[0])):
        n, bad = Counter(), Counter()
        for _, t, toxic in rows:
            for w in {cut(w) for w in t.split()} - {None}:
                n[w] += 1
                bad[w] += toxic
        least = max(weak_labels.TOXIC_ROWS, int(np.ceil(np.log(len(n) / 0.01) / np.log(len(rows) / sum(b for *_, b in rows)))))
        want |= {int(code(w)) for w in n if bad[w] >= least and bad[w] >= weak_labels.TOXIC_SHARE * n[w]}
    assert {int(x) for x in found} == want and int(of("vilest").code[0]) in want


def test_classifier_on_held_out_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    scorer = weak_labels.fit(docs, labels.where("crc32(cast(doc_id as string)) % 4 <> 1"))
    rows = weak_labels.score(docs, scorer).join(labels.where("crc32(cast(doc_id as string)) % 4 = 1"), "doc_id").toPandas()
    good = (rows.quality == 1) & (rows.toxic == 0)
    assert rows[good].kept.mean() > 0.97 and rows[rows.quality == 0].kept.mean() < 0.1


def test_classifier_sample_is_bounded_by_features(spark):
    """Long texts: what comes to the driver is a bounded number of distinct features, and the scorer still learns."""
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(3000)], [f"b{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(bad if i % 2 else good, k=2000)) + ".") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, whole = (weak_labels.fit(docs, labels, cells=n) for n in (20_000, 10**7))
    assert 0 < np.count_nonzero(few.weights) <= 20_000 and np.count_nonzero(whole.weights) > np.count_nonzero(few.weights)
    for scorer in (few, whole):
        assert all((r.bad_score > 0.5) == (r.doc_id % 2 == 1) for r in weak_labels.score(docs, scorer).collect())


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        scorer = weak_labels.fit(docs, given)
        rows = weak_labels.score(docs, scorer).collect()
        assert len(rows) == docs.count() and all(0 <= r.bad_score <= 1 for r in rows)
        assert weak_labels.keep(docs, scorer).schema == docs.schema
    empty = weak_labels.fit(docs.limit(0), labels)
    assert weak_labels.score(docs.limit(0), empty).count() == 0


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, state, sf_dir), name)
        assert out.columns == docs.columns
        had, has = {r.doc_id: r.text for r in state.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert has.items() <= had.items() <= before.items()
        if name == "quality_rules":
            for i, t in had.items():
                n, _, _, _, repeated, covered, longest = repetition_of(t, repetition.MIN_WORDS)
                assert (i in has) == (n >= 50 and 100 * repeated <= 50 * n and covered <= repetition.MAX_FRACTION * n and longest <= repetition.MAX_REPEAT)
        if name == "quality_classifier":
            labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            clean = [i for i in had if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
            assert sum(i in has for i in clean) >= 0.95 * len(clean)
        if name == "simhash_near_dedup":
            ids = sorted(had)
            stay = {ids[r] for r in groups([had[i] for i in ids])}
            assert stay <= set(has) and len(set(has) - stay) <= 0.03 * (len(ids) - len(stay)) + 1
        if name == "benchmark_decontamination":
            windows = set()
            for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
                w = ALNUM.findall(lower(r.text or ""))
                windows |= {tuple(w[j : j + 10]) for j in range(len(w) - 9)} if len(w) > 9 else {tuple(w)} if w else set()
            sizes = {len(k) for k in windows}
            for i, t in had.items():
                w = ALNUM.findall(lower(t))
                assert (i in has) != any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))
        state = out
    rows = corpus_pipeline.STAGES[-1][1](spark, state, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in state.collect()}
    assert max(sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}) <= packing.TOKENS
    sizes = Counter(r.sequence_id for r in rows)
    assert max(sizes.values()) <= corpus_pipeline.SEQUENCE_DOCUMENTS and all(len(r.ids) == 4 * r.length for r in rows)


def test_pipeline_edges(spark, sf_dir):
    """Null ids, repeated ids and rows, another column, and an empty table run through."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(40).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).union(docs.limit(40)).union(docs.limit(20)).withColumn("node", F.lit(1))
    for start in (odd, odd.limit(0)):
        state = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = corpus_pipeline.written(stage(spark, state, sf_dir), name)
            assert state.columns == start.columns
        rows = state.collect()
        assert len({r.text for r in rows}) == len(rows) and not any(r.doc_id is None for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, state, sf_dir).count() >= len(rows)
