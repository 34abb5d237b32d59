"""Best-fit packing of documents into sequences, with vectors of capacities.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of squared piece lengths).  In
order of falling length, each piece goes to the open sequence that keeps every capacity and scores least: by the
weighted norm of what would stay free ("norm"), or by the weighted dot product of the piece and what is free ("dot").
Either is best-fit: the tightest sequence that still fits.  A piece that fits nowhere opens a sequence.

Pieces are dealt to shards of about `shard_pieces` by their rows' places in the written table of pieces, not by ids, so
neither rows without an id nor repeated ids crowd a shard.  A shard is packed in one task, in bounded memory, and
leaves at most a few sequences unfilled (under 0.1 % of a shard's).  Only longer documents than a sequence are cut.

With the default capacities the documents' and the attention's follow from the tokens' (a piece has a token; a sum of
squares is at most the square of the sum), so as few sequences as can be come out; smaller ones bind.

Defined cases: a null text is empty, an empty text is its end token alone; repeated rows are packed once each; pieces of
equal length are packed in the order of their ids, null ids last; an empty table has no sequence; other columns are not
read; a very long text is encoded alone and cut.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_chunks, written
from .tokens import WordEncoder, tokenizer_path

TOKENS, SHARD_PIECES, END_ID = 4096, 4096, 1
TOKENIZER = "word_bpe_49k.json"


def pieces(docs: DataFrame, text: str = "text", id: str = "doc_id", tokens: int = TOKENS, end_id: int = END_ID, path: str | None = None, with_ids: bool = True, kept_words: int | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and its end, cut at every `tokens` ids.

    ids holds little-endian unsigned 32-bit ids.  kept_words: words that each of a worker's two stores keeps (tokens.KEPT_WORDS); fewer take less memory and more time.
    """
    path = path or tokenizer_path(TOKENIZER)
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, number, start, parts = [], [], [], []
        encoder = WordEncoder.of(path)
        encoder.kept = kept_words
        for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * tokens)):
                rows.append(i)
                number.append(k)
                start.append(at // 4)
                parts.append(ids[at : at + 4 * tokens])
        out = {id: batch.column(0).take(pa.array(rows)), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) // 4 for x in parts], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_chunks(docs.select(id, text), text, work, schema)


def packed(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths fall.  A piece over a capacity has a sequence of its own."""
    n, limit = len(lengths), np.array(capacity, dtype=np.float64)
    free = np.empty((3, n))
    used, sequence, offset, count = np.zeros(n, dtype=np.int64), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64), 0
    scale = np.sqrt(np.array(weights)) / limit if rule == "norm" else np.array(weights) / limit**2
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1, length * length], dtype=np.float64)
        open_free = free[:, :count]
        fits = np.flatnonzero((open_free >= need[:, None]).all(axis=0))
        if len(fits):
            rest = open_free[:, fits]
            score = (((rest - need[:, None]) * scale[:, None]) ** 2).sum(axis=0) if rule == "norm" else (rest * (need * scale)[:, None]).sum(axis=0)
            k = int(fits[np.argmin(score)])
        else:
            k, count = count, count + 1
            free[:, k] = limit
        free[:, k] -= need
        sequence[i], offset[i] = k, used[k]
        used[k] += length
    return sequence, offset


def pack(found: DataFrame, id: str = "doc_id", tokens: int = TOKENS, documents: int = TOKENS, attention: int = TOKENS * TOKENS, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces, with all their columns, and sequence_id and offset."""
    found = written(found, "pieces")
    spark = found.sparkSession
    shards = max(1, -(-found.count() // shard_pieces))
    partitions = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = packed(pdf["length"].to_numpy(), (tokens, documents, attention), weights, rule)
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy().astype(np.int64) << 32) | sequence, offset=offset).drop(columns="shard")

    dealt = found.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).repartition(partitions, "shard")  # a file's rows keep their places
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("shard").applyInPandas(work, schema)
