"""Benchmark decontamination by training suffix arrays.

The documents are the shards' text: a task builds the suffix array of one chunk of documents after another, over
words and `words` deep, and binary-searches every benchmark suffix in it.  A suffix of `words` words (a whole item that
has fewer) is a window; the ranges found give every verbatim occurrence and its place.  Windows that no text of the
chunk has, by their hashes, are left out of the search: it could only find nothing.  The longest verbatim match of a document is
the longest common prefix of one of its hit places with the benchmark's own sorted suffixes, found by bisection.

The benchmark is the stated query set.  Equal items are one class.  Classes are dealt to blocks of about `block_words`
words; texts are searched for one block after another, so one block's words (8 bytes each) are in memory at a
time.  Where there are several blocks, one pass over the documents first finds the texts that may have a window of any block, by a
Bloom filter of all windows (BLOOM_BITS a benchmark word), and only those are searched.  A window stands for the set
of a block's classes that have it, so a passage that many items share costs what one does: a
document gives each set once, and which items a set has comes from joins, once for each combination of sets.

Defined cases: null or empty documents have no words and no hit; an item without words has no window; equal items are
all reported, an item id that stands on several rows once; a null item id is reported as an empty string; repeated rows
each get a row; empty tables are searched like any other; a very long text is a chunk of its own; other columns, whatever
their names, are not read by scan() and kept by keep().
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Text, Words, covered, dropped, map_chunks, mixed, windows, written
from .suffixes import prefix_ranges, suffix_array

WORDS, BLOCK_WORDS = 10, 1 << 21
#: Of the filter that comes before several blocks: bits a benchmark word (rounded up to a power of two), and probes.
BLOOM_BITS, PROBES = 16, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of symbols times powers before each place, powers): equal stretches have equal sums but for a power."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(symbols), _BASE)]), dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(symbols * power[:-1], dtype=np.uint64)]), power


class Bloom:
    """Hashes of all windows of all blocks: may say yes to others, never no to one of them."""

    def __init__(self, words: int, n: int):
        self.n, self.sizes = n, set()
        self.mask = np.uint64((1 << max(10, (BLOOM_BITS * words - 1).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, dtype=np.uint8)

    def add(self, block: "Block") -> None:
        for k, (value, _, _) in block.windows.items():
            self.sizes.add(k)
            for j in range(PROBES):
                at = self.place(value, k, j)
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def place(self, value: np.ndarray, k: int, j: int) -> np.ndarray:
        return mixed(value + np.uint64((k * PROBES + j) * int(_BASE) & (1 << 64) - 1)) & self.mask

    def texts(self, words: Words) -> np.ndarray:
        """Which texts may have a window."""
        symbols, out = words.hashes(), np.zeros(words.text.n, dtype=bool)
        for k in self.sizes:
            value, at = windows(symbols, words.doc, k)
            for j in range(PROBES):
                place = self.place(value, k, j)
                there = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                value, at = value[there], at[there]
            out[words.doc[at]] = True
        return out


class Block:
    """Some distinct item texts, as word hashes.  What is derived from them is computed once a worker."""

    def __init__(self, classes: list[int], texts: list[bytes], n: int):
        self.classes, self.texts, self.n, self.windows = classes, texts, n, None

    def ready(self) -> "Block":
        if self.windows is not None:
            return self
        size = np.array([len(x) // 8 for x in self.texts], dtype=np.int64)
        self.symbols = np.frombuffer(b"".join(self.texts), dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        code = np.array(self.classes, dtype=np.int64)
        self.windows = {}
        for k in sorted({min(self.n, x) for x in size.tolist()}):  # (sorted hashes, a place, the set of classes) of distinct windows of k words
            value, at = windows(self.symbols, self.doc, k)
            if k < self.n:
                whole = size[self.doc[at]] == k
                value, at = value[whole & (at == begin[self.doc[at]])], at[whole & (at == begin[self.doc[at]])]
            sort = np.lexsort((self.doc[at], value))
            value, at = value[sort], at[sort]
            own = np.ones(len(value), dtype=bool)  # a class that has a window twice counts once
            own[1:] = (value[1:] != value[:-1]) | (self.doc[at][1:] != self.doc[at][:-1])
            value, at = value[own], at[own]
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.empty(0, dtype=np.int64)
            self.windows[k] = (value[first], at[first], np.bitwise_xor.reduceat(code[self.doc[at]], first) if len(first) else code[:0])
        if len(self.symbols):
            self.order, _, self.last = suffix_array(self.symbols, self.doc, by_doc=False)
            self.sums, self.power = prefix_sums(self.symbols)
        return self

    def longest(self, symbols: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, class number) of the longest match of the suffix at each place with a suffix of an item."""
        sums, power = prefix_sums(symbols)

        def common(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            length, most = np.zeros(len(p), dtype=np.int64), np.minimum(last[p] - p, self.last[q] - q)
            step = 1 << int(most.max()).bit_length() if len(p) else 0
            while step:
                at = np.flatnonzero(length + step <= most)
                a, b = p[at] + length[at], q[at] + length[at]
                same = (sums[a + step] - sums[a]) * self.power[b] == (self.sums[b + step] - self.sums[b]) * power[a]
                length[at[same]] += step
                step >>= 1
            return length

        low, high = np.zeros(len(place), dtype=np.int64), np.full(len(place), len(self.order), dtype=np.int64)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            p, q = place[live], self.order[middle]
            k = common(p, q)
            ended = q + k >= self.last[q]
            below = ended | ((p + k < last[p]) & (self.symbols[np.minimum(q + k, len(self.symbols) - 1)] < symbols[np.minimum(p + k, len(symbols) - 1)]))
            low[live[below]] = middle[below] + 1
            high[live[~below]] = middle[~below]
        sides = [self.order[np.clip(low + d, 0, len(self.order) - 1)] for d in (-1, 0)]
        lengths = [common(place, q) for q in sides]
        return np.maximum(*lengths), self.doc[np.where(lengths[0] >= lengths[1], *sides)]


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, place): every place of each range, and the range's number."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Found:
    """What the texts of a chunk have of a block: which words are hit, where windows begin, and each text's sets of classes."""

    def __init__(self, texts: pa.Array, block: Block):
        text = Text(texts, lower=True)
        self.words = words = text.words(ALNUM)
        self.n, self.hit = text.n, np.zeros(len(words), dtype=bool)
        self.starts = np.empty(0, dtype=np.int64)
        starts, docs, sets = [], [], []
        if len(words) and block.windows:
            self.symbols = words.hashes()
            order, _, self.last = suffix_array(self.symbols, words.doc, by_doc=False, depth=block.n)
            for k, (hashes, place, own_sets) in block.windows.items():
                own, _ = windows(self.symbols, words.doc, k)
                at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                there = np.unique(at[hashes[at] == own])
                low, high = prefix_ranges(self.symbols, self.last, order, block.symbols[place[there][:, None] + np.arange(k)], np.full(len(there), k))
                which, row = expanded(low, high - low)
                start = order[row]
                self.hit |= covered(start, k, len(words))
                starts.append(start)
                docs.append(words.doc[start])
                sets.append(own_sets[there][which])
            self.starts = np.unique(np.concatenate(starts))
        pairs = np.unique(np.stack([np.concatenate([*docs, np.empty(0, dtype=np.int64)]), np.concatenate([*sets, np.empty(0, dtype=np.int64)])], axis=1), axis=0)
        self.docs, self.sets = pairs[:, 0], pairs[:, 1]

    def spans(self) -> list[list[tuple[int, int]]]:
        """The hit stretches of each text, as word numbers."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], self.hit.view(np.int8)])))
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        cuts = np.unique(np.concatenate([self.words.at, edge]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if self.hit[a]:
                d = int(self.words.doc[a])
                out[d].append((a - int(self.words.at[d]), b - int(self.words.at[d])))
        return out


def benchmark_classes(benchmark: DataFrame, text: str, id: str) -> tuple[DataFrame, DataFrame]:
    """(class, words) of the distinct item texts that have words, and (class, item)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Text(batch.column(1), lower=True).words(ALNUM)
        symbols = words.hashes()
        raw = [symbols[a:b].tobytes() for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist())]
        some = [i for i, x in enumerate(raw) if x]
        code = np.array([xxhash.xxh3_64_intdigest(raw[i]) for i in some], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"class": pa.array(code), "item": batch.column(0).take(pa.array(some, pa.int32())), "words": pa.array([raw[i] for i in some], pa.binary())})

    rows = benchmark.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    rows = written(map_chunks(rows, "text", work, "class long, item string, words binary"), "items")
    return written(rows.select("class", "words").dropDuplicates(["class"]), "classes"), rows.select("class", "item").distinct()


def class_sets(classes: DataFrame, n: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(set, class) of every set of a block's classes that a window stands for, and a table to drop afterwards; a set is known by the exclusive or of its classes."""

    def work(batches):
        for batch in batches:
            for code, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, dtype=np.uint64)
                k = min(n, len(own))
                value = np.unique(windows(own, np.zeros(len(own), dtype=np.int64), k)[0])
                yield pa.RecordBatch.from_pydict({"class": pa.array(np.full(len(value), code)), "words": pa.array(np.full(len(value), k, dtype=np.int32)), "window": pa.array(value.view(np.int64))})

    rows = written(classes.mapInArrow(work, "class long, words int, window long").withColumn("block", block_of("class", count)), "windows")
    key = ["block", "words", "window"]
    one = rows.groupBy(*key).agg(F.bit_xor("class").alias("set")).groupBy("set").agg(F.min(F.struct(*key)).alias("w")).select("set", "w.*")
    return rows.join(one, key).select("set", "class"), rows


def block_of(code: str, count: int) -> F.Column:
    return F.pmod(F.xxhash64(code), F.lit(count))


def block_count(classes: DataFrame, block_words: int) -> tuple[int, int]:
    """(words of all classes, number of blocks)."""
    words = (classes.agg(F.sum(F.octet_length("words")).cast("long")).first()[0] or 0) // 8
    return words, max(1, -(-words // block_words))


def block(classes: DataFrame, n: int, k: int, count: int) -> Block:
    """The k-th block; its size is known before it is read."""
    rows = classes.where(block_of("class", count) == k).toArrow()
    return Block(rows["class"].to_pylist(), rows["words"].to_pylist(), n)


def blocks_of(classes: DataFrame, n: int, count: int):
    """One block after another, as broadcasts."""
    for k in range(count):
        yield classes.sparkSession.sparkContext.broadcast(block(classes, n, k, count))


def bloom_of(classes: DataFrame, n: int, words: int, count: int):
    """The filter of all blocks' windows, as a broadcast."""
    out = Bloom(words, n)
    for k in range(count):
        out.add(block(classes, n, k, count).ready())
    return classes.sparkSession.sparkContext.broadcast(out)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row a document: n_words, n_hit, items (sorted strings), contaminated, and its longest match: words, place (a word number) and item."""
    classes, items = benchmark_classes(benchmark, item_text, item_id)
    total, count = block_count(classes, block_words)
    kind = docs.schema[id].dataType.simpleString()
    keys = ["key", "key2"]  # of the text: rows with equal texts have equal matches
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"))
    base = None
    if count > 1:
        bloom = bloom_of(classes, words, total, count)

        def look(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = Text(batch.column(1), lower=True).words(ALNUM)
            maybe = pc.if_else(pa.array(bloom.value.texts(own)), batch.column(1), pa.scalar(None, batch.schema.field(1).type))
            return pa.RecordBatch.from_pydict({"id": batch.column(0), "key": batch.column(2), "key2": batch.column(3), "n_words": pa.array(np.diff(own.at), pa.int64()), "text": maybe})

        base = written(map_chunks(rows, "text", look, f"id {kind}, key long, key2 long, n_words long, text string"), "seen")
        bloom.unpersist()
        rows = base.where("text IS NOT NULL").dropDuplicates(keys).select("id", "text", *keys)
    hits = []
    for one in blocks_of(classes, words, count):

        def work(batch: pa.RecordBatch, first=base is None, one=one) -> pa.RecordBatch:
            own = one.value.ready()
            f = Found(batch.column(1), own)
            best = [(None, None, None)] * f.n
            if len(f.starts):
                length, code = own.longest(f.symbols, f.last, f.starts)
                d = f.words.doc[f.starts]
                for i in np.lexsort((-f.starts, length, d)):  # the last of a text is its longest, the first of equals
                    best[d[i]] = (int(length[i]), int(f.starts[i] - f.words.at[d[i]]), own.classes[code[i]])
            at = np.searchsorted(f.docs, np.arange(f.n + 1)).astype(np.int32)
            columns = {"id": batch.column(0), "key": batch.column(2), "key2": batch.column(3), "n_words": pa.array(np.diff(f.words.at), pa.int64()), "n_hit": pa.array(f.words.per_doc(f.hit), pa.int64())}
            columns |= {"spans": pa.array([[{"a": a, "b": b} for a, b in x] for x in f.spans()], pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()}))), "sets": pa.ListArray.from_arrays(pa.array(at), pa.array(f.sets, pa.int64()))}
            columns |= {"longest": pa.array([None if x[0] is None else {"words": x[0], "at": x[1], "class": x[2]} for x in best], pa.struct({"words": pa.int64(), "at": pa.int64(), "class": pa.int64()}))}
            out = pa.RecordBatch.from_pydict(columns)
            return out if first else out.filter(pa.array(f.words.per_doc(f.hit) > 0))

        schema = f"id {kind}, key long, key2 long, n_words long, n_hit long, spans array<struct<a:long,b:long>>, sets array<long>, longest struct<words:long,at:long,class:long>"
        hits.append(written(map_chunks(rows, "text", work, schema), "hits"))
        base = base or hits[0]
        one.unpersist()
    everything = reduce(DataFrame.union, [x.where("n_hit > 0").drop("id").dropDuplicates(keys) for x in hits])
    union = "aggregate(array_sort(flatten(collect_list(spans))), struct(0L as n, 0L as stop), (s, x) -> struct(s.n + greatest(0L, x.b - greatest(x.a, s.stop)) as n, greatest(x.b, s.stop) as stop), s -> s.n)"
    most = F.max(F.struct(F.col("longest.words").alias("words"), (-F.col("longest.at")).alias("at"), F.col("longest.class").alias("class"))).alias("longest")
    texts = everything.groupBy(*keys).agg(F.expr(union).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"), most)
    texts = written(texts, "texts")
    combined = texts.select("sets").distinct()
    of_sets, all_windows = class_sets(classes, words, count)
    named = combined.select("sets", F.explode("sets").alias("set")).join(of_sets, "set").select("sets", "class").distinct().join(items, "class").groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items"))
    least = items.groupBy(F.col("class").alias("longest_class")).agg(F.min("item").alias("longest_item"))
    result = texts.withColumn("longest_class", F.col("longest.class")).join(named, "sets").join(least, "longest_class").select(*keys, "n_hit", "items", F.col("longest.words").alias("longest_words"), (-F.col("longest.at")).alias("longest_at"), "longest_item")
    result = written(result, "matches")
    for old in (all_windows, texts, classes, *(x for x in hits if x is not base)):
        dropped(old)
    out = base.select("id", *keys, "n_words").join(result, keys, "left")
    return out.select(F.col("id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("longest_words", F.lit(0)).cast("long").alias("longest_words"), "longest_at", "longest_item")


def keep(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", words: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a hit, with all their columns."""
    classes, _ = benchmark_classes(benchmark, item_text, item_id)
    total, count = block_count(classes, block_words)
    rows, clean, before = docs, None, None
    if count > 1:  # what cannot have a window is kept at once, the rest is searched for one block after another
        bloom = bloom_of(classes, words, total, count)
        split = lambda want: map_chunks(docs, text, lambda batch: batch.filter(pa.array(bloom.value.texts(Text(batch.column(text), lower=True).words(ALNUM)) == want)), docs.schema)
        clean, rows = split(False), written(split(True), "maybe")
        before = rows
    for number, one in enumerate(blocks_of(classes, words, count)):

        def work(batch: pa.RecordBatch, one=one) -> pa.RecordBatch:
            f = Found(batch.column(text), one.value.ready())
            return batch.filter(pa.array(f.words.per_doc(f.hit) == 0))

        rows = map_chunks(rows, text, work, docs.schema)
        if number + 1 < count:  # one block's words at a time
            rows = written(rows, "kept")
            one.unpersist()
            dropped(before)
            before = rows
    return rows if clean is None else clean.union(rows)


def items_digest(items) -> F.Column:
    """SHA-256 of the comma-joined items."""
    return F.sha2(F.array_join(items, ","), 256)
