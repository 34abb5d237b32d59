"""Importance resampling towards a target: documents are drawn without replacement, by weights from hashed n-grams.

Features are the runs of 1 to `most` words; a feature's bucket is the CRC-32 of its bytes.  The corpus and the target are counted
by bucket; a bucket's gain is the logarithm of the ratio of its smoothed shares.  A document's weight is the mean gain of
its features, and its score the weight plus Gumbel noise that depends on its id alone; the highest scores are drawn.

Texts are read twice, to count and to weigh; either way a task interns the n-grams of a slice of texts in an open-addressed table
(ngram_table): an n-gram's bucket is found once a slice, counting adds up the slots' counts, and weighing gathers the gains
by the slots of the occurrences.  A task emits one count a bucket, which Spark adds up; the gains, `buckets` numbers, are
broadcast.  Ranks come from a sort by range and the sizes of the ranges, so no task sees all scores.

Defined cases: null and empty texts, and texts without words, have no features and weight 0; equal scores are ranked by smaller
id, null ids last and noised as the empty id; repeated rows get a row each and are drawn each on its own; empty documents
give an empty result; an empty target has T = 0; a very long text is worked on in slices; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Text, chunks, dropped, map_chunks, written
from .ngram_table import slices

BUCKETS, RUN_WORDS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7


def bucket_counts(docs: DataFrame, text: str = "text", most: int = RUN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any."""

    def work(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i, j in chunks(batch, text):
                for slots, _ in slices(Text(batch.column(0).slice(i, j - i), lower=True).words(ALNUM), most, buckets):
                    np.add.at(total, slots.bucket[slots.used], slots.count[slots.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    return docs.select(text).mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, in thousandths; what the driver gets is a row a bucket."""

    def dense(counts: DataFrame) -> np.ndarray:
        rows, out = counts.toArrow(), np.zeros(buckets, dtype=np.int64)
        out[np.asarray(rows["bucket"])] = np.asarray(rows["n"])
        return out

    s, t = dense(corpus), dense(target)
    ratio = (t + 1.0) * (float(s.sum()) + buckets) / ((s + 1.0) * (float(t.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", id: str = "doc_id", most: int = RUN_WORDS) -> DataFrame:
    """(id, n_words, n_features, weight): weight is the floored mean of the gains of a document's features."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Text(batch.column(1), lower=True).words(ALNUM)
        total, n = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        for slots, doc in slices(words, most, buckets):
            np.add.at(total, doc, shared.value[slots.bucket][slots.slot])
            n += np.bincount(doc, minlength=batch.num_rows)
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "n_words": pa.array(np.diff(words.at), pa.int64()), "n_features": pa.array(n), "weight": pa.array(total // np.maximum(n, 1))})

    return map_chunks(docs.select(id, text), text, work, f"id {docs.schema[id].dataType.simpleString()}, n_words long, n_features long, weight long").withColumnRenamed("id", id)


def ranked(rows: DataFrame, order: list, number: str) -> DataFrame:
    """rows with their place (from 1) in this order, by ranges: a range's rows are numbered within it, then after those before."""
    spark = rows.sparkSession
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_place", 33)
    before, total = [], 0
    for k, n in sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect()):  # a row a range
        before.append((k, total))
        total += n
    table = spark.createDataFrame(before, "_part long, _before long")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part", "left").withColumn(number, F.col("_before") + within + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text", most: int = RUN_WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    # The last column tells repeated rows apart, so that a range can end between them.
    scored = weights(docs, gain, text, id, most).select(F.col(id).alias("id"), "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("may"), F.monotonically_increasing_id().alias("row"))
    scored = written(scored, "scored")
    may = scored.where("may")
    n_drawn = percent * may.count() // 100
    inside = ranked(may, [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], "rank")
    rank = F.when(F.col("rank") <= n_drawn, F.col("rank")).alias("rank")
    out = inside.select("id", "n_features", "weight", "score", rank).union(scored.where("not may").select("id", "n_features", "weight", "score", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id)
