"""Helpers that the text operators share: bounded chunks of an Arrow batch, word boundaries and word hashes in numpy,
and tables written to the shared checkpoint folder.

Texts reach Python as Arrow string arrays.  Their UTF-8 bytes are read in place, a few MB at a time, so a task's memory
depends neither on the number of documents nor on the size of its partition.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at a time (one longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local session gets a fresh folder; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_set(keep: Callable[[int], bool]) -> np.ndarray:
    return np.array([keep(i) for i in range(256)], dtype=bool)


#: Bytes of words that white space (space, tab to carriage return) ends.
NOT_SPACE = byte_set(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of a-z, 0-9 and everything outside ASCII (texts are lower-cased first).
ALNUM = byte_set(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about `limit` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


class Text:
    """Some texts' bytes, each followed by a line feed.  `first[i]` is where text i begins; the last entry is the end."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        values = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
        self.n = len(values)
        self.raw = b"\n".join([*values, b""])
        self.first = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in values], out=self.first[1:])
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
            self.raw = self.bytes.tobytes()

    def words(self, is_word: np.ndarray) -> "Words":
        return Words(self, is_word)


class Words:
    """Word i is bytes[start[i]:end[i]] of text doc[i]; text d's words are i in [at[d], at[d + 1])."""

    def __init__(self, text: Text, is_word: np.ndarray):
        self.text = text
        self.inside = is_word[text.bytes]
        edge = np.flatnonzero(np.diff(self.inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.searchsorted(text.first, self.start, "right") - 1
        self.at = np.searchsorted(self.start, text.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.text.bytes, self.start, self.end)

    def per_doc(self, weights: np.ndarray) -> np.ndarray:
        """Sum over each text's words."""
        total = np.concatenate([[0], np.cumsum(weights)])
        return total[self.at[1:]] - total[self.at[:-1]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each (non-empty, disjoint, ascending) span, in slices of about `limit` bytes; a longer span is cut into such slices."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    lengths = end - start
    power = np.cumprod(np.full(min(limit, int(lengths.max())), _BASE, dtype=np.uint64))
    total, i = np.cumsum(lengths), 0
    while i < len(start):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + limit, "right")))
        n, size = lengths[i:j], int(total[j - 1] - base)
        if size > limit:  # one long span
            sums = [int(((data[a : min(a + limit, end[i])].astype(np.uint64) + np.uint64(1)) * power[: min(limit, end[i] - a)]).sum()) for a in range(int(start[i]), int(end[i]), limit)]
            whole = sum(x * pow(int(_BASE), k * limit, 1 << 64) for k, x in enumerate(sums)) % (1 << 64)
            out[i] = np.uint64(whole) ^ np.uint64(size)
        else:
            offset = np.cumsum(n) - n
            local = np.arange(size) - np.repeat(offset, n)
            value = (data[np.repeat(start[i:j], n) + local].astype(np.uint64) + np.uint64(1)) * power[local]
            out[i:j] = np.add.reduceat(value, offset) ^ n.astype(np.uint64)
        i = j
    return mixed(out)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words that lie in one text, and their first words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * _BASE + hashes[k : k + m])
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return out[at], at


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def map_chunks(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """work() on every chunk of rows; it returns the rows to emit."""

    def each(batches):
        for batch in batches:
            for i, j in chunks(batch, column, limit):
                out = work(batch.slice(i, j - i))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(each, schema)
