"""Near copies of documents: SimHash with anchor points proposes, exact Jaccard similarity of five-word shingles decides.

A text is the set of its shingles (of lower-cased words between white space; a shorter text is one shingle).  Its
fingerprint has 320 bits.  Texts of similarity 0.8 differ in about 15 % of them, too many for `simhash`'s three
segments, so there are more segments here: `segments` random choices of 20 of the last 192 bits.  Each segment is covered by the
same code as in `simhash`, with threshold 0: a fingerprint goes to its home and visits the anchors within the covering
radius.  Two texts of similarity 0.8 meet at an anchor of a given segment with a chance of about 0.1, and at one of
72 segments with 0.99 (0.999 from similarity 0.85 on); the tests hold the whole against brute force.  Texts that are not
similar meet at an anchor with a chance of about 2 in 100,000; far beyond 100 million texts, take wider segments and more of them.

First, homes are compared with visitors by the first 128 bits, which no segment has.  A text with one partner is held
against it.  Texts with more partners go to their anchors again with a sketch: the whole fingerprint and 512 parities of shingle
hashes (two sets differ in at least as many shingles as their parities).  Pairs that sizes and sketches allow are nearly always similar;
of them a spanning forest is held against the whole sets, never a group's pairs.  If a forest's pair fails, the texts of its
tree go to their anchors once more, with WIDE parities: these tell a similarity of 0.75 from 0.8 for texts of up to some
thousand words, so a crowd of texts that are nearly similar proposes a small share of its pairs (about 1 % at 0.74), not most of them; the pairs that are allowed and still apart are checked,
so that no link is lost to a pair that failed.

keep() chooses a row, not an id: of each component the row with the least id (null ids last), then the least text hash;
of rows that repeat both, one.  That depends neither on the order of rows nor on their partitions.

Defined cases: null and empty texts are equal sets; repeated rows are copies; a row with a null id stays only if its
group has no id; texts of rows with one id may differ and are then judged on their own; an empty table stays empty; all
columns are kept, whatever their names.  A very long text is worked on alone.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Text, dropped, map_chunks, mixed, windows, written
from .components import components
from .simhash import BLOCK, SHARE, compared, dealt, flips, labels, syndromes

SHINGLE_WORDS, FINGERPRINT_BITS, FIRST_BITS, PARITIES, SEGMENT_BITS, SEGMENT_COUNT = 5, 320, 128, 512, 20, 72
#: Most of the first bits, and of all bits, that may differ: 3.5 standard deviations over the mean at similarity 0.8.
CHECK_BITS, ALL_BITS = 34, 71
#: Pairs of rows compared at a time; parities of texts in a tree with a pair that failed.
PAIRS, WIDE = 1 << 17, 4096
#: Most rows of a table of wanted texts that is broadcast.
BROADCAST_ROWS = 1 << 20
_SPREAD = np.random.default_rng(64).integers(1 << 62, size=(FINGERPRINT_BITS // 64, 2)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, hash) of every shingle, and the number of texts."""
    text = Text(texts, lower=True)
    words = text.words(NOT_SPACE)
    hashes = words.hashes()
    value, at = windows(hashes, words.doc, n)
    owner = words.doc[at]
    size = np.diff(words.at)
    for k in range(1, n):  # shorter texts
        first = words.at[:-1][size == k]
        whole = np.full(len(first), k, dtype=np.uint64)
        for i in range(k):
            whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[first + i])
        value, owner = np.concatenate([value, whole]), np.concatenate([owner, np.flatnonzero(size == k)])
    return owner, value, text.n


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, hash, node): text i's distinct shingles are hash[first[i]:first[i + 1]], ascending; node[i] is their digest."""
    owner, value, n = shingles(texts)
    sort = np.lexsort((value, owner))
    owner, value = owner[sort], value[sort]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    first = np.searchsorted(owner, np.arange(n + 1))
    node = np.array([xxhash.xxh3_64_intdigest(value[i:j].tobytes()) for i, j in zip(first[:-1].tolist(), first[1:].tolist())], dtype=np.uint64)
    return first, value, node


def wide_fingerprints(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A row of 40 bytes a set: a bit is 1 if more than half of the shingles' hashes have it."""
    out = np.zeros((len(first) - 1, FINGERPRINT_BITS // 8), dtype=np.uint8)
    for d, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        ones = np.zeros(FINGERPRINT_BITS, dtype=np.uint32)
        for a in range(i, j, 255):  # a byte holds 255 at most
            hashes = mixed(value[a : min(j, a + 255), None] * _SPREAD[:, 0] + _SPREAD[:, 1])
            ones += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
        out[d] = np.packbits(2 * ones > j - i)
    return out


def parities(first: np.ndarray, value: np.ndarray, bits: int = PARITIES) -> np.ndarray:
    """A row of bits // 8 bytes a set: whether it has an odd number of shingles for each remainder of their hashes."""
    out, many = np.empty((len(first) - 1, bits // 8), dtype=np.uint8), max(1, (1 << 19) // bits)
    for at in range(0, len(out), many):
        i, j = first[at], first[min(at + many, len(out))]
        own = first[at : at + many + 1] - i
        owner = np.repeat(np.arange(len(own) - 1), np.diff(own))
        odd = np.bincount(owner * bits + (value[i:j] % np.uint64(bits)).astype(np.int64), minlength=bits * (len(own) - 1)) & 1
        out[at : at + many] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1)
    return out


def sketches(first: np.ndarray, value: np.ndarray, bits: int = PARITIES) -> pa.Array:
    return pa.array([x.tobytes() for x in np.concatenate([wide_fingerprints(first, value), parities(first, value, bits)], axis=1)], pa.binary())


def segment_places(segments: int) -> np.ndarray:
    """Which bits each segment has, drawn so that some at a time have none in common; the first bits are left for the check."""
    draw, each = np.random.default_rng(20), (FINGERPRINT_BITS - FIRST_BITS) // SEGMENT_BITS
    rows = [FIRST_BITS + draw.permutation(FINGERPRINT_BITS - FIRST_BITS)[: each * SEGMENT_BITS].reshape(each, -1) for _ in range(-(-segments // each))]
    return np.concatenate(rows)[:segments]


def visits(prints: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, home, row) of every place that each fingerprint (a row of bytes) goes to; key: the segment and the anchor."""
    bits = np.unpackbits(prints, axis=1)
    part = (bits[:, places].astype(np.uint32) << np.arange(SEGMENT_BITS, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    row = np.repeat(np.arange(len(part)), part.shape[1])
    number = np.tile(np.arange(part.shape[1], dtype=np.uint64) << np.uint64(SEGMENT_BITS), len(part))
    part = part.ravel().astype(np.uint64)
    kind = syndromes(part)
    flip = np.where(kind > 0, np.uint64(1) << np.maximum(kind, np.uint64(1)) - np.uint64(1), np.uint64(0))
    anchor = (part ^ flip) | number
    on = np.flatnonzero(kind == 0)  # words of the code have more anchors within 1: a flip of each bit outside the code's
    near = np.array(flips(0, SEGMENT_BITS, 1)[1:], dtype=np.uint64)
    key = np.concatenate([anchor, anchor, (anchor[on][:, None] ^ near).ravel()])
    home = np.arange(len(key)) < len(anchor)
    return key.astype(np.int64), home, np.concatenate([row, row, np.repeat(row[on], len(near))])


def prints(docs: DataFrame, text: str, id: str) -> DataFrame:
    """(id, hash, node, n, sketch): hash tells rows of an id apart; node is the digest of the text's set of n shingles; its fingerprint and parities."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, value, node = sets(batch.column(1))
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "hash": batch.column(2), "node": pa.array(node.view(np.int64)), "n": pa.array(np.diff(first).astype(np.int32)), "sketch": sketches(first, value)})

    kind = docs.schema[id].dataType.simpleString()
    return map_chunks(docs.select(id, text, F.xxhash64(text)), text, work, f"id {kind}, hash long, node long, n int, sketch binary")


def allowed(n: tuple[np.ndarray, np.ndarray], sketch: tuple[np.ndarray, np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs (u of the first, v of the second) may be similar, by their sizes and sketches (rows of 64-bit words)."""
    least, most = np.minimum(n[0][u], n[1][v]).astype(np.int64), np.maximum(n[0][u], n[1][v]).astype(np.int64)
    out, cut = 5 * least >= 4 * most, FINGERPRINT_BITS // 64
    differ = lambda at, own: np.bitwise_count(sketch[0][u[at], own] ^ sketch[1][v[at], own]).sum(axis=1, dtype=np.int64)
    at = np.flatnonzero(out)
    out[at] = differ(at, slice(0, cut)) <= ALL_BITS
    for at in np.array_split(np.flatnonzero(out), max(1, int(out.sum()) >> 14)):
        out[at] = 9 * differ(at, slice(cut, None)) <= least[at] + most[at]
    return out


def met(number: np.ndarray, columns: dict[str, np.ndarray], pairs: int = PAIRS):
    """(homes, visitors) as rows of columns: pairs of different roots in a group that may be similar, some at a time."""
    homes, visitors = np.flatnonzero(columns["home"]), np.flatnonzero(~columns["home"])
    visitors = visitors[np.lexsort((columns["root"][visitors], number[visitors]))]
    at, group = number[visitors], number[homes]
    first, last = np.searchsorted(at, group, "left"), np.searchsorted(at, group, "right")
    # Visitors of the home's own root are a range, which is left out.
    ranks, rank = np.unique(columns["root"], return_inverse=True)
    both, mine = at.astype(np.int64) * len(ranks) + rank[visitors], group.astype(np.int64) * len(ranks) + rank[homes]
    skip, go_on = np.searchsorted(both, mine, "left"), np.searchsorted(both, mine, "right")
    start, count, which = np.concatenate([first, go_on]), np.concatenate([skip - first, last - go_on]), np.concatenate([homes, homes])
    total, i = np.cumsum(count), 0
    while i < len(count):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + pairs, "right")))
        c = count[i:j]
        u = np.repeat(which[i:j], c)
        v = visitors[np.repeat(start[i:j] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        words = columns["sketch"][:, : FIRST_BITS // 64]
        near = np.bitwise_count(words[u, 0] ^ words[v, 0]) <= CHECK_BITS
        u, v = u[near], v[near]
        near = np.bitwise_count(words[u] ^ words[v]).sum(axis=1) <= CHECK_BITS
        u, v = u[near], v[near]
        if "n" in columns and len(u):
            near = allowed((columns["n"],) * 2, (columns["sketch"],) * 2, u, v)
            u, v = u[near], v[near]
        if len(u):
            yield u, v
        i = j


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the links make a spanning forest: every component takes the first link that leaves it, until none does."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label, live, chosen = np.arange(len(nodes)), np.arange(len(u)), []
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.unique(np.concatenate(chosen)) if chosen else live
        first = np.full(len(nodes), len(u))
        np.minimum.at(first, label[a[live]], live)
        np.minimum.at(first, label[b[live]], live)
        picked = np.unique(first[first < len(u)])
        chosen.append(picked)
        label = labels(label[a[picked]], label[b[picked]], len(nodes))[label]


def at_anchors(nodes: DataFrame, work, schema: str, segments: int, block: int, share: int, whole: bool) -> DataFrame:
    """work() on groups of what nodes (node, root, n, sketch) send to their anchors: whole sketches with sizes and roots, or first bits alone."""
    places = segment_places(segments)

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 10):
                part = batch.slice(at, 1 << 10)
                sketch = part.column(3)
                key, home, row = visits(np.frombuffer(b"".join(sketch.to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)[:, : FINGERPRINT_BITS // 8], places)
                columns = {"node": part.column(0)} | ({"root": part.column(1), "n": part.column(2), "sketch": sketch} if whole else {"sketch": pa.array([x[: FIRST_BITS // 8] for x in sketch.to_pylist()], pa.binary())})
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int32)), "home": home} | {c: x.take(pa.array(row)) for c, x in columns.items()})

    fields = "key int, home boolean, node long, " + "root long, n int, " * whole + "sketch binary"
    sent = lambda rows: rows.select("node", "root", "n", "sketch").mapInArrow(send, fields)
    few = nodes.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0)
    return compared(dealt(sent(nodes), sent(few), share, block), work, schema)


def partners(nodes: DataFrame, *sizes: int) -> DataFrame:
    """(node, least, greatest) of every node that meets others whose first bits are near: its least and greatest partner."""

    def ends(number, columns):
        columns["root"], kept = columns["node"], np.empty((3, 0), dtype=np.int64)
        for u, v in met(number, columns):  # what is known so far, and what the new pairs add to it
            own, other = columns["node"][np.concatenate([u, v])], columns["node"][np.concatenate([v, u])]
            own, least, greatest = np.concatenate([kept, np.stack([own, other, other])], axis=1)
            sort = np.argsort(own, kind="stable")
            own = own[sort]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            kept = np.stack([own[first], np.minimum.reduceat(least[sort], first), np.maximum.reduceat(greatest[sort], first)])
        if kept.size:
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("node", "least", "greatest"), kept)})

    found = at_anchors(nodes, ends, "node long, least long, greatest long", *sizes, whole=False)
    return found.groupBy("node").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def proposed(nodes: DataFrame, every: bool, *sizes: int) -> DataFrame:
    """(a, b): pairs of different roots that sketches allow; a spanning forest of the roots, or all of them."""

    def pairs(number, columns):
        def emitted(u, v):
            ends = np.unique(np.sort(np.stack([columns["node"][u], columns["node"][v]], axis=1), axis=1), axis=0)
            return pa.RecordBatch.from_pydict({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

        kept = np.empty((2, 0), dtype=np.int64)
        for found in met(number, columns):
            if every:
                yield emitted(*found)
            else:  # the forest so far, and what the new pairs add to it
                kept = np.concatenate([kept, np.stack(found)], axis=1)
                kept = kept[:, spanning(columns["root"][kept[0]], columns["root"][kept[1]])]
        if kept.size:
            yield emitted(*kept)

    return at_anchors(nodes, pairs, "a long, b long", *sizes, whole=True).distinct()


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(text) of the rows whose text has a hash of wanted (hash); a table of few is broadcast."""
    hashes = wanted.select("hash").distinct()
    hashes = F.broadcast(hashes) if wanted.count() <= BROADCAST_ROWS else hashes
    return docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("hash")).join(hashes, "hash", "left_semi").select("text")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The pairs whose sets are similar, as a written table."""
    pairs = written(pairs, "pairs")
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))

    def near(batches):
        for batch in batches:
            n = tuple(np.asarray(batch.column(c)) for c in ("a_n", "b_n"))
            sketch = tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in ("a_sketch", "b_sketch"))
            row = np.arange(batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(allowed(n, sketch, row, row)))

    half = written(pairs.join(of("a"), "a"), "pairs")
    close = written(half.join(of("b"), "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(near, "a long, b long"), "close")
    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    wanted = written(wanted.join(nodes.select("node", "best.hash"), "node"), "wanted")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, value, node = sets(batch.column(0))
        return pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "shingles": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))})

    whole = written(map_chunks(texts_of(docs, text, wanted), "text", work, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    side = lambda s: whole.select(F.col("node").alias(s), F.col("shingles").alias(f"{s}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    links = written(close.join(side("a"), "a").join(side("b"), "b").where(9 * common >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b"), "links")
    for old in (pairs, half, close, wanted, whole):
        dropped(old)
    return links


def linked(docs: DataFrame, text: str = "text", id: str = "doc_id", segments: int = SEGMENT_COUNT, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(node, best, root) a distinct set: best is the row that stands for it (id is null, id, hash of the text), root its component."""
    found, sizes = written(prints(docs, text, id), "prints"), (segments, block, share)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best")
    nodes = written(found.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), best), "nodes")
    met_by = written(partners(nodes.withColumn("root", F.col("node")), *sizes), "partners")
    lone = met_by.where("least = greatest").select(F.least("node", "least").alias("a"), F.greatest("node", "least").alias("b")).distinct()
    busy = written(nodes.join(met_by.where("least <> greatest").select("node"), "node").select("node", F.col("node").alias("root"), "n", "sketch"), "busy")
    forest = written(proposed(busy, False, *sizes), "forest")
    links = verified(lone.union(forest).distinct(), nodes, docs, text)
    roots = components(links)
    failed = written(forest.join(links, ["a", "b"], "left_anti"), "failed")
    if not failed.isEmpty():
        # The texts of trees with a pair that failed, with wide sketches.
        trees = components(forest)
        hit = written(failed.select(F.col("a").alias("node")).join(trees, "node").select("root").distinct(), "hit")  # a table whose size is known before it is joined
        inside = written(trees.join(hit, "root", "left_semi").select("node").join(nodes.select("node", "n", F.col("best.hash").alias("hash")), "node"), "inside")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            first, value, node = sets(batch.column(0))
            return pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "sketch": sketches(first, value, WIDE)})

        wide = map_chunks(texts_of(docs, text, inside), "text", work, "node long, sketch binary").dropDuplicates(["node"])
        apart = written(inside.join(wide, "node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "sketch"), "apart")
        more = verified(proposed(apart, True, *sizes), nodes, docs, text)
        roots = components(links.union(more))
        for old in (hit, inside, apart, more):
            dropped(old)
    dropped(failed)
    out = written(nodes.select("node", "best").join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root")), "linked")
    for old in (found, nodes, met_by, busy, forest, links):
        dropped(old)
    return out


def keep(docs: DataFrame, text: str = "text", id: str = "doc_id", segments: int = SEGMENT_COUNT, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """One document of each group of near copies, with all its columns."""
    chosen = linked(docs, text, id, segments, block, share).groupBy("root").agg(F.min("best").alias("best"))
    keys = [f"_{part}_{uuid.uuid4().hex}" for part in ("id", "none", "hash")]  # no column of docs has such a name
    chosen = written(chosen.select(F.xxhash64("best.id").alias(keys[0]), F.col("best.none").alias(keys[1]), F.col("best.hash").alias(keys[2])), "chosen")
    rows = docs.withColumns(dict(zip(keys, (F.xxhash64(id), F.col(id).isNull(), F.xxhash64(text)))))
    # Rows that repeat a key meet in one, first within each task; the join then needs no further exchange.
    return rows.dropDuplicates(keys).join(chosen, keys, "left_semi").select(*docs.columns)
