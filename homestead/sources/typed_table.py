"""A table source whose columns are named by letters of a type string, read by row ranges with pushed filters.

A table is a folder with one file of records for each range of rows. Each record is a line of tab-separated fields; a type string has a letter for each
column: m (number of the matrix), v (number that is the target), t (text) or x (not read). Registered as format "typed_table".

    write_typed_table(df, path)
    read_typed_table(spark, path, "tmvx", ["a", "b", "c", "d"])

Tasks open the files by path, so the folder has to be one that all machines mount.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

KINDS = {"m": (T.DoubleType(), pa.float64()), "v": (T.DoubleType(), pa.float64()), "t": (T.StringType(), pa.string())}
#: Bytes of a file that are read and parsed at once.
BLOCK = 8 << 20
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class Range(InputPartition):
    """A part of a file: lines that begin at or after `begin` and before `end`."""

    def __init__(self, path: str, begin: int, end: int):
        super().__init__(None)
        self.path, self.begin, self.end = path, begin, end


def local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


class TypedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "typed_table"

    def columns(self) -> list[tuple[int, str, str]]:
        """Place, name and letter of the columns that are read."""
        names, letters = self.options["names"].split(","), self.options["types"]
        if len(names) != len(letters) or set(letters) - set("mvtx"):
            raise ValueError(f"type string {letters!r} does not fit {len(names)} columns")
        return [(i, n, k) for i, (n, k) in enumerate(zip(names, letters, strict=True)) if k != "x"]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, KINDS[k][0]) for _, n, k in self.columns()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TypedReader(self.options, self.columns())


class TypedReader(DataSourceReader):
    """Reads ranges of files in blocks; comparisons of columns with constants are applied block by block before rows leave the reader."""

    def __init__(self, options: dict[str, str], columns: list[tuple[int, str, str]]):
        self.path, self.columns, self.filters = local(options["path"]), columns, []
        self.split = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {n: KINDS[k][0] for _, n, k in self.columns}
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.filters.append((f.attribute[0], None, None))
            elif type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in known and isinstance(f.value, str if isinstance(known[f.attribute[0]], T.StringType) else (int, float)):
                self.filters.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        files = sorted(glob.glob(os.path.join(glob.escape(self.path), "part-*"))) if os.path.isdir(self.path) else [self.path]
        return [Range(f, at, min(at + self.split, size)) for f in files if (size := os.path.getsize(f)) for at in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as file:
            if partition.begin:  # the line that begins before this range belongs to the one before
                file.seek(partition.begin - 1)
                file.readline()
            while file.tell() < partition.end:
                block = file.read(min(BLOCK, partition.end - file.tell())) + file.readline()
                batch = self.parsed(block.decode("utf-8").split("\n")[: -1 if block.endswith(b"\n") else None])
                if batch.num_rows:
                    yield batch

    def parsed(self, lines: list[str]) -> pa.RecordBatch:
        rows = [line.split("\t") for line in lines]
        arrays = []
        for i, _, kind in self.columns:
            text = [r[i] if i < len(r) and r[i] != "" else None for r in rows]
            arrays.append(pa.array([_number(x) for x in text], pa.float64()) if kind in "mv" else pa.array([x and x.replace("\\t", "\t").replace("\\n", "\n") for x in text], pa.string()))
        batch = pa.RecordBatch.from_arrays(arrays, [n for _, n, _ in self.columns])
        keep = None
        for name, compare, value in self.filters:
            column = batch.column(name)
            one = column.is_valid() if compare is None else COMPARE[compare](column, pa.scalar(value, column.type))
            keep = one if keep is None else pc.and_kleene(keep, one)
        return batch if keep is None else batch.filter(keep)


def read_typed_table(spark: SparkSession, path: str, types: str, names: list[str], **options: str) -> DataFrame:
    """The columns of a folder that write_typed_table wrote, or of one file. Filters that compare a column with a constant reach the reader (the session's setting for that is switched on)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TypedTable)
    return spark.read.format(TypedTable.name()).options(types=types, names=",".join(names), **options).load(path)


def _number(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def write_typed_table(df: DataFrame, path: str) -> None:
    """df as a folder of records; null is an empty field, as is an empty text. Tabs and line ends in texts are written as two characters."""
    def field(f: T.StructField):
        c = F.col(f"`{f.name}`").cast("string")
        for real, mark in (("\t", "\\t"), ("\n", "\\n")):
            c = F.replace(c, F.lit(real), F.lit(mark))
        return F.coalesce(c, F.lit(""))

    df.select(F.concat_ws("\t", *(field(f) for f in df.schema)).alias("value")).write.mode("overwrite").text(path)
