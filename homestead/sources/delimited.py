"""Delimited and key-value text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.shared import written

# Month names of index files.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def read_delimited(spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = ",", na: tuple[str, ...] = ("", "NA"), header: bool = True, strict: bool = True) -> DataFrame:
    """Typed scan. Missing-value strings become null; what a column's type cannot hold is an error, or null if not strict.

    Columns are read as text, so that each missing-value string is known, and cast after; Spark prunes the columns not used.
    """
    types = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in types])
    rows = spark.read.schema(text).csv(path, sep=sep, header=header, quote='"', escape='"', mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=not header)

    def typed(f: T.StructField):
        c = F.when(F.col(f"`{f.name}`").isin(*na), None).otherwise(F.col(f"`{f.name}`"))
        return (c.cast(f.dataType) if strict else c.try_cast(f.dataType)).alias(f.name)

    return rows.select(*(typed(f) for f in types))


def read_inferred(spark: SparkSession, path: str, sep: str = ",", na: tuple[str, ...] = ("", "NA"), header: bool = True) -> DataFrame:
    """A column is a number if every value is one or missing, else a string. Unnamed columns become "V n". One extra pass finds the kinds."""
    rows = spark.read.csv(path, sep=sep, header=header, quote='"', escape='"', inferSchema=False)
    names = [f"V {i + 1}" if not c or c.startswith("_c") else c for i, c in enumerate(rows.columns)]
    rows = rows.toDF(*names)
    clean = rows.select(*(F.when(F.col(f"`{c}`").isin(*na), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names))
    odd = clean.agg(*(F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(str(i)) for i, c in enumerate(names))).first()
    return clean.select(*(F.col(f"`{c}`").cast("double").alias(c) if odd[i] == 0 else F.col(f"`{c}`") for i, c in enumerate(names)))


def read_with_header_file(spark: SparkSession, data: str, header: str, sep: str = "\t") -> DataFrame:
    """Data without a header line, its names from another file."""
    names = spark.read.text(header).first()[0].split(sep)
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(data, sep=sep)


def read_many(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files as one frame with the file's name and its number in the list."""
    parts = [read_delimited(spark, p, **options).withColumns({"file_name": F.lit(p.rsplit("/", 1)[-1]), "file_number": F.lit(i + 1)}) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_numbered(spark: SparkSession, paths: list[str], schema: str | T.StructType, sep: str = "\t", na: tuple[str, ...] = ("", "NA"), header: bool = True) -> DataFrame:
    """Several files (or folders of one file each) as one frame, with file_name, file_number (from 1, in the list) and record_number (from 1, in the file).

    Lines are read once, with the block of their file and their place in the task, into a table; the number of lines in each block, one row a block,
    gives the records before it. The header is no record. Quoting is not known here; a field that its type cannot hold is null.
    """
    types = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = written(spark.read.text(paths).select("value", file.alias("__file"), block.alias("__block"), F.monotonically_increasing_id().alias("__at")), "lines")
    sizes = lines.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    names = written(lines.select("__file").distinct().withColumn("__number", _number_of(paths)), "files")
    rows = lines.join(F.broadcast(placed), ["__file", "__block"]).join(F.broadcast(names), "__file")
    rows = rows.withColumn("__record", F.col("__before") + F.col("__at") - F.col("__first") + (0 if header else 1)).where("__record > 0")
    fields = F.split("value", re.escape(sep), -1)
    typed = [F.when(~F.get(fields, F.lit(i)).isin(*na), F.get(fields, F.lit(i))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(types)]
    return rows.select(*typed, F.element_at(F.split("__file", "/"), -1).alias("file_name"), F.col("__number").alias("file_number"), F.col("__record").alias("record_number"))


def _number_of(paths: list[str]):
    """The place in the list of the path that a file is or lies in."""
    number = F.lit(None).cast("int")
    for i, path in enumerate(paths):
        plain = re.sub("^[a-z]+:/*", "/", path).rstrip("/")
        number = F.when(F.endswith("__file", F.lit(plain)) | F.contains("__file", F.lit(plain + "/")), i + 1).otherwise(number)
    return number


def read_after_lines(spark: SparkSession, path: str, skip: int, names_line: int, sep: str = ",") -> DataFrame:
    """A file whose first `skip` lines are no data; line `names_line` (from 1) has the names.

    Of lines equal to a skipped one only as many go as are skipped, the first in the file's first block; data rows that equal them stay.
    """
    top = [r[0] for r in spark.read.text(path).limit(skip).collect()]
    names = top[names_line - 1].split(sep)
    lines = spark.read.text(path).select("value", (F.input_file_block_start() == 0).alias("early"), F.monotonically_increasing_id().alias("at"))
    alike = F.col("early") & F.col("value").isin(*top)
    often = F.create_map(*(F.lit(x) for line in dict.fromkeys(top) for x in (line, top.count(line))))
    again = lines.where(alike).withColumn("nth", F.row_number().over(Window.partitionBy("value").orderBy("at"))).where(F.col("nth") > F.element_at(often, F.col("value")))
    rows = lines.where(~alike).select("value").union(again.select("value"))
    return rows.select(F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)), {"sep": sep}).alias("r")).select("r.*")


def read_checked(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """Records as text columns, and a frame of rejects (line, n_fields) of those whose number of fields is not that of the names."""
    lines = spark.read.text(path).withColumn("f", F.split("value", re.escape(sep), -1))
    good = lines.where(F.size("f") == len(names)).select(*(F.col("f")[i].alias(n) for i, n in enumerate(names)))
    return good, lines.where(F.size("f") != len(names)).select(F.col("value").alias("line"), F.size("f").alias("n_fields"))


def read_month_index(spark: SparkSession, path: str, skip: int = 7, names_line: int = 7) -> DataFrame:
    """year, month and level of an index whose dates are like "Jan 2008" or "Jan-2008"; rows without a level are left out."""
    rows = read_after_lines(spark, path, skip, names_line)
    day, level = rows.columns[0], rows.columns[1]
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.substring(day, 1, 3)).cast("int")
    return rows.select(F.substring(day, 5, 4).try_cast("int").alias("year"), F.nullif(month, F.lit(0)).alias("month"), F.col(f"`{level}`").try_cast("double").alias("level")).where("level IS NOT NULL")


def create_table_as(df: DataFrame, name: str, replace: bool = True) -> DataFrame:
    """A table of the catalog made from a frame."""
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Key, tab, value lines."""
    return spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("key"), F.get("p", 1).alias("value"))


def read_captures(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern as columns; lines that it does not match are left out."""
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(*(F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def read_single_column(spark: SparkSession, path: str, kind: str = "double", header: bool = True) -> DataFrame:
    return read_delimited(spark, path, f"value {kind}", header=header)


def write_delimited(df: DataFrame, path: str, sep: str = ",", na: str = "NA", header: bool = True, quote_all: bool = False, compression: str = "none") -> None:
    """NaN and null are written as the missing-value string."""
    plain = df.select(*(F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema))
    plain.write.csv(path, sep=sep, nullValue=na, header=header, quoteAll=quote_all, escape='"', compression=compression, mode="overwrite")


def write_pairs(df: DataFrame, path: str, key: str, value: str) -> None:
    df.select(F.concat_ws("\t", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_columns(df: DataFrame, path: str, sorted_by: list[str] = []) -> None:  # noqa: B006
    """A column store: readers take only the columns they name."""
    (df.sortWithinPartitions(*sorted_by) if sorted_by else df).write.mode("overwrite").parquet(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_split(valid: DataFrame, rejects: DataFrame, path: str) -> None:
    """Kept and rejected rows beside each other."""
    valid.write.mode("overwrite").parquet(f"{path}/valid")
    rejects.write.mode("overwrite").parquet(f"{path}/rejects")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
