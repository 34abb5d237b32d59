"""SimHash near-duplicates by anchor-point covering.

Fingerprints at most `bits` apart differ in at most bits // 3 places of one of three segments (22, 21 and 21 bits).
Each segment's space is covered by a code: the perfect [15, 11] Hamming code on 15 of its bits, all values on the rest.
Every word is within 1 of exactly one code word, its home anchor, so a fingerprint within t of another on a segment
is within 1 + t of the other's home.  A fingerprint goes once to its home and to every anchor within 1 + t as a
visitor; homes are compared with visitors, anchor by anchor, over all 64 bits.  With t = 1 that is 16 visits a segment
on average and 2**18 anchors, which suits some hundred million fingerprints.  The segments are a parameter: two of 32 bits (WIDE_SEGMENTS, t = 2) have
2**28 anchors each, and more visits, for as many times more fingerprints.  Results do not depend on them.

Equal fingerprints are one node from the start, so thousands of copies cost what one does.  Anchors that more than
`block` fingerprints reach are cut into blocks of homes and of visitors; every pair of blocks is its own group.  A group
yields a spanning forest of the links it has found, never its pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows each get a row; a row
with a null id gets its component's smallest id that is not null, or null if there is none.  An empty table gives an
empty result; other columns, whatever their names, are not read.  A very long text is worked on alone, its bits added up a slice at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, Text, dropped, map_chunks, written
from .components import components

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Offset and width of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
WIDE_SEGMENTS = ((32, 32), (0, 32))
CODED = 15
#: Most homes, and most visitors, of an anchor that one group compares; pairs compared at a time.
BLOCK, PAIRS = 4096, 1 << 21
#: One fingerprint in so many tells which anchors are crowded.
SHARE = 16


def fingerprint_values(texts: pa.Array, n: int = SHINGLE_WORDS) -> np.ndarray:
    """A 64-bit fingerprint of each text: bit i is 1 if more than half the shingles' hashes have it."""
    text = Text(texts, lower=True)
    words = text.words(NOT_SPACE)
    out, digest, bits = np.zeros(text.n, dtype=np.uint64), xxhash.xxh64_intdigest, np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    sizes = words.end - words.start
    for d in range(text.n):
        i, j = words.at[d], words.at[d + 1]
        if i == j:
            continue
        first, last = words.start[i:j], words.end[i:j]
        if int(last[-1] - first[0]) == int(sizes[i:j].sum()) + (j - i - 1) and text.raw.count(b" ", first[0], last[-1]) == j - i - 1:
            own = text.raw  # the words already stand one space apart
        else:
            own = b" ".join(text.raw[first[0] : last[-1]].split())
            last = np.cumsum(sizes[i:j] + 1) - 1
            first = last - sizes[i:j]
        k = min(n, j - i)
        values = [digest(own[a:b], SEED) for a, b in zip(first[: j - i - k + 1].tolist(), last[k - 1 :].tolist())]
        hashes = np.array(values, dtype=">u8").view(np.uint8)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(values), 1 << 15):
            part = np.unpackbits(hashes[8 * at : 8 * (at + (1 << 15))]).reshape(-1, 64)
            ones += part.sum(axis=0, dtype=np.uint32)
        out[d] = bits[2 * ones > len(values)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({id: batch.column(0), "fp": pa.array(fingerprint_values(batch.column(1), shingle_words).view(np.int64))})

    return map_chunks(docs.select(id, text), text, work, f"`{id}` {docs.schema[id].dataType.simpleString()}, fp long")


def syndromes(x: np.ndarray) -> np.ndarray:
    """Of the low 15 bits: 0 for a code word of the Hamming code, else 1 + the place to flip for the nearest one."""
    out = np.zeros(len(x), dtype=np.uint64)
    for i in range(CODED):
        out ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def flips(syndrome: int, width: int, radius: int) -> list[int]:
    """What to XOR to a word of this syndrome for every anchor within the radius (at most 3), of a segment this wide."""
    out = [0] if syndrome == 0 else [1 << (syndrome - 1)]
    coded = {1 << i: i + 1 for i in range(CODED)}
    patterns = {0: 0}
    for _ in range(radius):
        patterns |= {p | m: s ^ c for p, s in patterns.items() for m, c in coded.items() if not p & m}
    coded_flips = [p for p, s in patterns.items() if s == syndrome]
    free = [0]
    for _ in range(radius):
        free = sorted({p ^ (1 << i) if i is not None else p for p in free for i in (None, *range(CODED, width))})
    out = [a | b for a in coded_flips for b in free if (a | b).bit_count() <= radius]
    return sorted(out, key=lambda p: (p.bit_count(), p))


def key_bits(segments: tuple = SEGMENTS) -> int:
    """Bits of a key: a segment's number above an anchor."""
    return max(w for _, w in segments) + (len(segments) - 1).bit_length()


def visits(fp: np.ndarray, radius: int, segments: tuple = SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, home, index into fp) of every place that each fingerprint goes to; key: the segment and the anchor."""
    keys, homes, rows, above = [], [], [], max(w for _, w in segments)
    for number, (offset, width) in enumerate(segments):
        part = (fp >> np.uint64(offset)) & np.uint64((1 << width) - 1)
        kind = syndromes(part)
        for s in range(CODED + 1):
            at = np.flatnonzero(kind == s)
            if not len(at):
                continue
            near = np.array(flips(s, width, radius), dtype=np.uint64)
            home = flips(s, width, 1)[0]
            reached = np.concatenate([(part[at] ^ np.uint64(home))[:, None], part[at][:, None] ^ near], axis=1)
            keys.append((reached | np.uint64(number << above)).ravel())
            homes.append(np.tile(np.arange(len(near) + 1) == 0, len(at)))
            rows.append(np.repeat(at, len(near) + 1))
    return np.concatenate(keys).astype(np.int64), np.concatenate(homes), np.concatenate(rows)


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that links of n numbers lead to, for each of them."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of these links: as many links as are needed."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = labels(ends[: len(u)], ends[len(u) :], len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def group_links(key: np.ndarray, home: np.ndarray, fp: np.ndarray, bits: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and visitors of the same key, as a forest; rows are sorted by key."""
    visitor_fp, visitor_key = fp[~home], key[~home]
    home_fp, home_key = fp[home], key[home]
    first = np.searchsorted(visitor_key, home_key, "left")
    count = np.searchsorted(visitor_key, home_key, "right") - first
    total, found_u, found_v, i = np.cumsum(count), [], [], 0
    while i < len(home_fp):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + pairs, "right")))
        n = count[i:j]
        u = np.repeat(home_fp[i:j], n)
        v = visitor_fp[np.repeat(first[i:j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        near = (np.bitwise_count(u ^ v) <= bits) & (u != v)
        if near.any():
            a, b = forest(u[near], v[near])
            found_u.append(a)
            found_v.append(b)
        i = j
    if not found_u:
        return fp[:0], fp[:0]
    return forest(np.concatenate(found_u), np.concatenate(found_v))


def dealt(sent: DataFrame, few: DataFrame, share: int, block: int) -> DataFrame:
    """sent (key, home, ...) in order of group: a key's homes and visitors, or a pair of their blocks where either side is crowded.

    few: what `sent` has for one row in `share`; it tells which keys are crowded, and how many blocks their sides are cut
    into.  Results do not depend on it.  A row goes to its own block, once for each block of the other side.
    """
    sizes = few.groupBy("key").agg((F.count_if("home") * share).alias("homes"), (F.count_if(~F.col("home")) * share).alias("visitors"))
    hot = written(sizes.where(F.greatest("homes", "visitors") > block).select("key", F.ceil(F.greatest("homes", F.lit(1)) / block).cast("int").alias("home_blocks"), F.ceil(F.greatest("visitors", F.lit(1)) / block).cast("int").alias("visitor_blocks")), "anchors")
    payload = [c for c in sent.columns if c not in ("key", "home")]
    rows = sent.join(hot, "key", "left")
    blocks = lambda n: F.coalesce(n, F.lit(1))
    own = F.pmod(F.xxhash64(*payload), F.when(F.col("home"), blocks(F.col("home_blocks"))).otherwise(blocks(F.col("visitor_blocks")))).cast("int")
    other = F.when(F.col("home"), blocks(F.col("visitor_blocks"))).otherwise(blocks(F.col("home_blocks")))
    rows = rows.select("key", "home", *payload, own.alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    i, j = F.when(F.col("home"), F.col("own")).otherwise(F.col("other")), F.when(F.col("home"), F.col("other")).otherwise(F.col("own"))
    rows = rows.select("key", i.cast("short").alias("i"), j.cast("short").alias("j"), "home", *payload)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def values(column: pa.Array) -> np.ndarray:
    """A column in numpy; binary values of one size as rows of 64-bit words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)
    return np.asarray(column)


def compared(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(group number, columns) on some groups of dealt rows at a time, each whole."""

    def each(batches):
        rest: list[pa.RecordBatch] = []
        size = 0

        def done(table: pa.Table, whole: bool):
            columns = {c: values(table[c].combine_chunks()) for c in table.column_names}
            new = np.zeros(table.num_rows, dtype=bool)
            for k in ("key", "i", "j"):
                new[1:] |= columns[k][1:] != columns[k][:-1]
            stop = table.num_rows if whole else int(np.flatnonzero(new)[-1]) if new.any() else 0
            if stop:
                yield from work(np.cumsum(new)[:stop], {c: x[:stop] for c, x in columns.items()})
            return table.slice(stop)

        for batch in batches:
            rest.append(batch)
            size += batch.num_rows
            if size >= 1 << 18:
                left = yield from done(pa.Table.from_batches(rest), False)
                rest, size = left.to_batches(), left.num_rows
        if size:
            yield from done(pa.Table.from_batches(rest), True)

    return rows.mapInArrow(each, schema)


def near_links(nodes: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, share: int = SHARE, segments: tuple = SEGMENTS) -> DataFrame:
    """(a, b): links that connect all fingerprints of nodes.fp (distinct longs) at most `bits` apart.  segments: (offset, width) of each, together all 64 bits."""
    radius, small = 1 + bits // len(segments), key_bits(segments) < 32

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = np.asarray(batch.column(0)[at : at + (1 << 14)]).view(np.uint64)
                key, home, row = visits(fp, radius, segments)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.astype(np.int32) if small else key), "home": home, "fp": pa.array(fp[row].view(np.int64))})

    sent = lambda rows: rows.select("fp").mapInArrow(send, f"key {'int' if small else 'long'}, home boolean, fp long")

    def links(number, columns):
        u, v = group_links(number, columns["home"], columns["fp"].view(np.uint64), bits)
        if len(u):
            yield pa.RecordBatch.from_pydict({"a": pa.array(u.view(np.int64)), "b": pa.array(v.view(np.int64))})

    return compared(dealt(sent(nodes), sent(nodes.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0)), share, block), links, "a long, b long")


def linked(docs: DataFrame, text: str = "text", id: str = "doc_id", bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS, block: int = BLOCK, segments: tuple = SEGMENTS) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links lead to, the row's own included."""
    prints = written(fingerprints(docs, text, id, shingle_words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    roots = components(near_links(nodes, bits, block, segments=segments))
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    # Written, so that a join's hot side comes straight from its exchange and the skew join can split it.
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    for old in (nodes, rooted, least):
        dropped(old)
    return prints.join(named, "fp").select(id, "fp", "component_id")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
