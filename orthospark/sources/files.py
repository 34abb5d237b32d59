"""Paths and files through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a task lists in one round, and files at which it stops; files that it holds at a time; prefixes that are held against each other on the driver.
MOST_FOLDERS, MOST_FILES, ROWS, FEW_PREFIXES = 500, 200_000, 10_000, 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir; a temporary one only where that is unset in a local session)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length) of the files below a path, by Spark's own index of them, which the driver holds; their content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "modificationTime", "length")


def listed(prefixes: DataFrame, suffix: str = "", prefix: str = "prefix", most: int = MOST_FOLDERS) -> DataFrame:
    """(path, modificationTime, length) of the files below each prefix, listed by tasks, in rounds.

    A prefix is a folder, a file, or the beginning of names in a folder.  A task lists up to `most` folders from the ones it is given on
    and hands the rest to the next round, so neither the driver nor a task holds the tree; a round's folders are dealt
    anew.  Files are handed on some thousands at a time.  Prefixes that overlap give a file once; where none begins with another, files are not compared.  Names that begin with a dot or an underscore are left out, as Spark leaves them out; a prefix that does not exist has no
    files.  This goes through pyarrow's file systems.
    """
    spark = prefixes.sparkSession
    fields = "path string, modificationTime timestamp, length long, folder boolean"

    def expand(first: bool):
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.bool_()]

        def packed(rows: list):
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "modificationTime", "length", "folder"])

        def work(batches):
            from pyarrow import fs

            for batch in batches:
                todo, rows = [(x, first) for x in batch.column(0).to_pylist() if x], []
                done = found_files = 0
                while todo and done < most and found_files < MOST_FILES:
                    uri, given = todo.pop()
                    store, name = store_of(uri.rstrip("/"))
                    base, starts = uri.rstrip("/").removesuffix(name), ""
                    done += 1
                    if given:
                        own = store.get_file_info(name)
                        if own.type == fs.FileType.File:
                            rows.append((uri, own.mtime, own.size, False))
                            continue
                        if own.type == fs.FileType.NotFound:
                            name, _, starts = name.rpartition("/")
                            if uri.endswith("/") or not name:
                                continue
                    for found in store.get_file_info(fs.FileSelector(name, allow_not_found=True)):
                        if found.base_name[:1] in "._" or not found.base_name.startswith(starts):
                            continue
                        if found.type == fs.FileType.Directory:
                            todo.append((base + found.path, False))
                        elif found.base_name.endswith(suffix):
                            rows.append((base + found.path, found.mtime, found.size, False))
                            found_files += 1
                            if len(rows) >= ROWS:
                                yield packed(rows)
                                rows = []
                rows += [(uri, None, None, True) for uri, _ in todo]
                yield packed(rows)

        return work

    todo, out = prefixes.select(F.col(prefix).alias("path")).distinct(), None
    parts, first = int(spark.conf.get("spark.sql.shuffle.partitions")), True
    given = sorted(r[0] for r in todo.where("path is not null").limit(FEW_PREFIXES + 1).collect())
    apart = len(given) <= FEW_PREFIXES and not any(b.startswith(a) for a, b in zip(given, given[1:]))  # what begins with a prefix sorts right after it
    while True:
        path = scratch(spark, "listing")
        todo.repartition(parts, "path").mapInArrow(expand(first), fields).write.parquet(path)
        rows = spark.read.schema(fields).parquet(path)
        files = rows.where("not folder").drop("folder")
        out, todo, first = files if out is None else out.union(files), rows.where("folder").select("path").distinct(), False
        if todo.isEmpty():
            return out if apart else out.dropDuplicates(["path"])


def partition_values(files: DataFrame) -> DataFrame:
    """Distinct (region, year) that file paths name; an empty folder names nothing."""
    part = lambda name, pattern: F.nullif(F.regexp_extract("path", f"/{name}=({pattern})/", 1), F.lit(""))
    return files.select(part("region", "[^/]+").alias("region"), part("year", "[0-9]+").try_cast("int").alias("year")).where("region is not null and year is not null").distinct()


def store_of(path: str):
    """(file system, path in it) of a path or URI, on an executor."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file for reads of ranges: only what is asked for is fetched."""
    store, name = store_of(path)
    return store.open_input_file(name)


def write_objects(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's content as the object of that name below the folder, from tasks; returns how many.  A task that runs again writes the same."""

    def write(batches):
        store, top = store_of(folder)
        made = set()
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{top}/{key}"
                if (own := path.rpartition("/")[0]) not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                with store.open_output_stream(path) as out:
                    if data:
                        out.write(data.encode() if isinstance(data, str) else data)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select(name, content).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
