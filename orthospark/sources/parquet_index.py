"""Row-group indexes: the boxes of Parquet row groups, from footers alone, and reads that they narrow."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.spatial import WINDOW, range_join
from .files import listed, opened

MOST_GROUPS = 96


def scan_footers(spark: SparkSession, path: str, names: tuple = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """(file, row_group, num_rows, xmin, ymin, xmax, ymax) of each row group with statistics of all four leaves; raises if a leaf is missing.

    Files are listed by tasks; executors fetch each file's footer alone.
    """

    def footers(batches):
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                with opened(file) as source:
                    meta = pq.ParquetFile(source).metadata
                leaves = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                if missing := [n for n in names if n not in leaves]:
                    raise ValueError(f"{file} has no {', '.join(missing)}")
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    s = [group.column(leaves[n]).statistics for n in names]
                    if all(x is not None and x.has_min_max for x in s):
                        rows.append((file, g, group.num_rows, s[0].min, s[1].min, s[2].max, s[3].max))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "row_group", "num_rows", "xmin", "ymin", "xmax", "ymax"])

    return listed(spark.createDataFrame([(path,)], "prefix string"), ".parquet").select("path").mapInArrow(footers, "file string, row_group int, num_rows long, xmin double, ymin double, xmax double, ymax double")


def hits(index: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Row groups that any of the boxes meets, each once."""
    return range_join(index, boxes.select(*WINDOW).distinct(), size).select(*index.columns).distinct()


def read_groups(groups: DataFrame, columns: list[str], schema: T.StructType) -> DataFrame:
    """The rows of row groups (file, row_group), in these columns.  Groups are dealt to tasks one by one; a task opens each of its files once and reads ranges of it."""
    target = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def work(batches):
        for batch in batches:
            own: dict[str, list[int]] = {}
            for file, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(file, []).append(group)
            for file, numbers in own.items():
                with opened(file) as source:
                    for found in pq.ParquetFile(source).iter_batches(row_groups=sorted(numbers), columns=columns):
                        yield pa.RecordBatch.from_arrays([found.column(c).cast(target.field(c).type) for c in columns], schema=target)

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("file", "row_group").repartition(parts, "file", "row_group").mapInArrow(work, schema)


def read(spark: SparkSession, index: DataFrame, boxes: DataFrame, columns: list[str], size: float, most: int | None = MOST_GROUPS) -> DataFrame:
    """The rows of the row groups that any of the boxes meets, in the columns asked for, and of no other group.

    Refuses more than `most` row groups (none: reads any number, as tasks do the reading); an index without files has no columns to read.
    """
    found = hits(index, boxes, size)
    if most is not None and found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} row groups")
    one = index.select("file").first()
    if one is None:
        raise ValueError("the index has no files")
    return read_groups(found, columns, spark.read.parquet(one.file).select(*columns).schema)
