"""Fingerprints by one-permutation MinHash, with optimal densification and packed low-order bits.

Each five-word shingle of a text (a shorter text's whole word sequence) is hashed once; the top bits of a hash choose one of `bins`
bins, which keeps its least hash.  An empty bin takes the value of the first bin with one in a fixed random order of its own
(optimal densification: the order does not depend on the text, so texts with the same full bins agree on what they fill in).
The low-order `bits` of each bin's hash, packed, are the fingerprint: 256 bytes for the default 512 bins of 4 bits, in hex.
Bins of unrelated texts agree in one case in 2**bits by chance; likeness() takes that out, and estimates the Jaccard
similarity of the shingle sets with a standard error of at most 2.4 %.

compared() also fingerprints each text with its end replaced by the beginning of the next document's.  Texts move once: bounds of id ranges
are taken from the keys alone, every row goes to its range, and a range also gets the one row that begins the next range, so
the next document of each is the next row of the sorted range.  Rows of one key that fill several ranges are dealt to all of them.

Defined cases: words end at white space, and case counts for A-Z alone no more than in lower case; a null text is empty; texts
without words have the fingerprint zero; equal texts have equal fingerprints; rows with equal ids are ordered by a hash of their texts, null ids come
first; repeated rows each get a row and follow one another; the last document is followed by the first, a single one by itself;
an empty table gives an empty result; a very long text is worked on alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, NOT_SPACE, Text, map_chunks, mixed, windows

SHINGLE_WORDS, BINS, BITS = 5, 512, 4
#: Most texts that are fingerprinted at a time; bins that a text fills at least to have its empty ones filled by trial.
ROWS, FULL = 2048, 24


@cache
def visiting_order(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): order[i] are all bins in the order in which bin i asks them; rank[i, j] is when it asks bin j."""
    i = np.arange(bins, dtype=np.uint64)
    key = mixed((i[:, None] << np.uint64(32)) + i[None, :] + np.uint64(1))
    order = np.argsort(key, axis=1, kind="stable").astype(np.int32)
    return order, np.argsort(order, axis=1, kind="stable").astype(np.int32)


def shingles(text: Text, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle."""
    words = text.words(NOT_SPACE)
    hashes, size = words.hashes(), np.diff(words.at)
    value, at = windows(hashes, words.doc, n)
    values, docs = [value], [words.doc[at]]
    for k in range(1, n):  # texts of k words
        some = np.flatnonzero(size == k)
        if len(some):
            first, out = words.at[some], np.zeros(len(some), dtype=np.uint64)
            for j in range(k):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[first + j])
            values.append(out)
            docs.append(some)
    return np.concatenate(values), np.concatenate(docs)


def minima(texts: pa.Array, n: int = SHINGLE_WORDS, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(least, full): each text's least hash in each bin, and whether the bin has one."""
    text = Text(texts, lower=True)
    value, doc = shingles(text, n)
    least = np.full((text.n, bins), ~np.uint64(0))
    place = (value >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    flat = doc * bins + place
    np.minimum.at(least.reshape(-1), flat, value)
    full = np.zeros((text.n, bins), dtype=bool)
    full.reshape(-1)[flat] = True
    return least, full


def densified(least: np.ndarray, full: np.ndarray) -> np.ndarray:
    """least with every empty bin filled from the first full bin that it asks."""
    order, rank = visiting_order(least.shape[1])
    out, count = least.copy(), full.sum(axis=1)
    out[count == 0] = 0
    for d in np.flatnonzero((count > 0) & (count < FULL)).tolist():
        own, empty = np.flatnonzero(full[d]), np.flatnonzero(~full[d])
        out[d, empty] = least[d, own[np.argmin(rank[np.ix_(empty, own)], axis=1)]]
    doc, place = np.nonzero(~full & (count >= FULL)[:, None])
    step = 0
    while len(doc):
        asked = order[place, step]
        got = full[doc, asked]
        out[doc[got], place[got]] = least[doc[got], asked[got]]
        doc, place, step = doc[~got], place[~got], step + 1
    return out


def sketches(texts: list[str | None], n: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low-order bits of every bin of each text."""
    out = []
    for i in range(0, len(texts), ROWS):
        out.append((densified(*minima(pa.array(texts[i : i + ROWS], pa.string()), n, bins)) & np.uint64((1 << bits) - 1)).astype(np.uint8))
    return np.concatenate(out) if out else np.empty((0, bins), dtype=np.uint8)


def packed(values: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex of the bins' bits, one after another."""
    flags = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return [x.tobytes().hex() for x in np.packbits(flags.reshape(len(values), -1), axis=1)]


def corrected(same: np.ndarray, bits: int) -> np.ndarray:
    """Jaccard similarity from the share of bins that agree, less what agrees by chance."""
    chance = 0.5**bits
    return np.clip((same - chance) / (1 - chance), 0, 1)


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated similarity (0 to 1) of the texts of two fingerprints of equal size; null if either is null."""

    @F.arrow_udf("double")
    def estimate(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x.to_pylist(), y.to_pylist()):
            if p is None or q is None:
                out.append(None)
                continue
            differ = np.unpackbits(np.frombuffer(bytes.fromhex(p), dtype=np.uint8) ^ np.frombuffer(bytes.fromhex(q), dtype=np.uint8)).reshape(-1, bits).any(axis=1)
            out.append(float(corrected(1 - differ.mean(), bits)))
        return pa.array(out, pa.float64())

    return estimate(a, b)


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(id, fingerprint) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "fingerprint": pa.array(packed(sketches(batch.column(1).to_pylist(), n, bins, bits), bits), pa.string())})

    found = map_chunks(docs.select(id, text), text, work, f"id {docs.schema[id].dataType.simpleString()}, fingerprint string")
    return found.withColumnRenamed("id", id)


def with_next(docs: DataFrame, text: str, id: str, ranges: int) -> DataFrame:
    """(p, id, h, text, head): the rows in ranges p of (id, hash of the text), sorted, and after each range the first row of the next one (head)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # The third key divides rows of one key that are many.
    keys = rows.select("id", "h").repartitionByRange(ranges, F.asc_nulls_first("id"), "h", F.rand(7))
    found = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("least")).collect()  # a row a range
    bounds = sorted((x.least.known, x.least.id, x.least.h) for x in found)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for i, key in enumerate(zip(ids.is_valid().to_pylist(), ids.to_pylist(), hashes.to_pylist())):
            j = bisect_right(bounds, key) - 1
            if j > 0 and bounds[j] == key and bounds[j - 1] == key:  # a key of several ranges: one after another
                first = bisect_left(bounds, key)
                j = first + i % (j - first + 1)
            out.append(max(j, 0))
        return pa.array(out, pa.int32())

    begins = [(p, *bounds[(p + 1) % len(bounds)][1:]) for p in range(len(bounds))]
    table = spark.createDataFrame(begins, f"p int, own_id {kind}, own_h long")
    firsts = rows.join(F.broadcast(table.select("own_id", "own_h").distinct()), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left_semi")
    firsts = firsts.groupBy("id", "h").agg(F.any_value("text").alias("text"))
    heads = firsts.join(F.broadcast(table), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).select("p", "id", "h", "text", F.lit(True).alias("head"))
    dealt = rows.select(range_of("id", "h").alias("p"), "id", "h", "text", F.lit(False).alias("head")).union(heads)
    return dealt.repartitionById(max(1, len(bounds)), F.col("p")).sortWithinPartitions("p", "head", F.asc_nulls_first("id"), "h")


def compared(docs: DataFrame, text: str = "text", id: str = "doc_id", n: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS, ranges: int | None = None) -> DataFrame:
    """Of each document: n_chars, its fingerprint, that of its text with the last quarter replaced by the beginning of the next
    document's, the edited text's SHA-256, and the likenesses of its fingerprint to the edited text's and to the next document's."""
    spark = docs.sparkSession
    rows = with_next(docs, text, id, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id].dataType

    def done(own: list[tuple]) -> pa.RecordBatch | None:
        """Of all rows but the last, which is only followed."""
        texts = [x[1] for x in own]
        out = [i for i in range(len(own) - 1) if not own[i][2]]
        if not out:
            return None
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in out]
        prints, changed = sketches(texts, n, bins, bits), sketches(edited, n, bins, bits)
        at = np.array(out)
        columns = {"id": pa.array([own[i][0] for i in out], ids), "n_chars": pa.array([len(texts[i]) for i in out], pa.int64()), "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited]}
        columns |= {"fingerprint": packed(prints[at], bits), "edited_fingerprint": packed(changed, bits)}
        columns |= {"near_edited": corrected((prints[at] == changed).mean(axis=1), bits), "near_next": corrected((prints[at] == prints[at + 1]).mean(axis=1), bits)}
        return pa.RecordBatch.from_pydict(columns)

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(kind)

    def each(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                held.append(row)
                size += len(row[1])
                if size > CHUNK_BYTES // 2 or len(held) > ROWS:
                    if (found := done(held)) is not None:
                        yield found
                    held, size = held[-1:], len(row[1])
        if held and (found := done(held)) is not None:
            yield found

    schema = f"id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(each, schema).withColumnRenamed("id", id)
