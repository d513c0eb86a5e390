"""Scans that count while they run, and files that hold records of several kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.shared import shared_dir


def checked_scan(spark: SparkSession, path: str, schema: str | T.StructType, rules: dict[str, Column], sep: str = "\t", to: str | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Typed records that keep all rules, rejected lines with their reason, and counts, from one pass over the lines.

    A line is rejected for its number of fields ("fields"), else for the first field whose type cannot hold it (the field's name; an empty field is
    null), else for the first rule that does not hold (the rule's name; null does not hold). Both kinds are written beside each other, below `to` or
    a new shared folder, while an observation counts lines, kept and rejected ones and the rejects of each reason.
    """
    types = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.split("value", f"\\Q{sep}\\E", -1).alias("f"))
    text = [F.when(F.col("f")[i] != "", F.col("f")[i]) for i in range(len(types))]
    record = F.struct(*(text[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(types)))
    rows = lines.select("line", F.size("f").alias("n"), F.when(F.size("f") == len(types), F.array(*text)).alias("t"), F.when(F.size("f") == len(types), record).alias("r")).select("line", "n", "t", "r", "r.*")
    reason = F.when(F.col("n") != len(types), "fields")
    for i, f in enumerate(types):
        reason = reason.when(F.col("t")[i].isNotNull() & F.col(f"r.{f.name}").isNull(), f.name)
    for name, rule in rules.items():
        reason = reason.when(~F.coalesce(rule, F.lit(False)), name)
    marked = rows.withColumn("reason", reason).select("line", "r", "reason", F.col("reason").isNull().alias("kept"))
    names = ["fields", *(f.name for f in types), *rules]
    seen = Observation()
    counted = marked.observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), *(F.count_if(F.col("reason") == n).alias(f"rejected by {n}") for n in names))
    to = to or shared_dir(spark, "checked")
    counted.write.partitionBy("kept").parquet(to)
    back = spark.read.schema(marked.schema).parquet(to)
    return back.where("kept").select("r.*"), back.where("NOT kept").select("line", "reason"), dict(seen.get)


def report(spark: SparkSession, sections: dict[str, dict[str, int]]) -> DataFrame:
    """section, place, metric, value: what was counted, in order."""
    rows = [(s, i, m, int(v)) for s, counts in sections.items() for i, (m, v) in enumerate(counts.items())]
    return spark.createDataFrame(rows, "section string, place int, metric string, value long")


def _escaped(c: Column) -> Column:
    """Text without the separators: backslash, tab and line ends as two characters, null as \\N."""
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for real, mark in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(real), F.lit(mark))
    return F.coalesce(out, F.lit("\\N"))


def _plain(c: Column) -> Column:
    """The text that was escaped. Doubled backslashes are set aside first."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for real, mark in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(mark), F.lit(real))
    return F.when(c != "\\N", F.replace(out, F.lit("\u0000"), F.lit("\\")))


def _line(tag: str, columns: list[str], row: Column | None = None) -> Column:
    return F.concat_ws("\t", F.lit(tag), *(_escaped(F.col(c) if row is None else row[c]) for c in columns))


def _lines(kind: str, fields: list[str]) -> Column:
    return F.transform("__rows", lambda r: _line(kind, fields, r))


def write_groups(parents: DataFrame, children: dict[str, DataFrame], key: str, path: str, tag: str = "A") -> None:
    """Text files of groups: a line of the parent (its tag, then its fields), then a line for each child, kind by kind, in the order of the child's fields.

    Keys of parents are unique and not null; children without a parent are left out. Children do not repeat the key. A group is one record of its
    file. Texts may hold anything but the character 0.
    """
    rows = parents.select(F.col(key).alias("__key"), _line(tag, parents.columns).alias("__first"))
    for kind, df in children.items():
        fields = [c for c in df.columns if c != key]
        grouped = df.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__rows"))
        lines = grouped.select("__key", _lines(kind, fields).alias(f"__{kind}"))
        rows = rows.join(lines, "__key", "left")
    rows.select(F.concat_ws("\n", "__first", *(f"__{kind}" for kind in children)).alias("value")).write.mode("overwrite").text(path)


def read_groups(spark: SparkSession, path: str, parent: str, children: dict[str, str], tag: str = "A") -> DataFrame:
    """Parents with an array of structs for each kind of children, as write_groups wrote them; types by schema strings.

    A record goes from one parent's line to the next, whatever lies between, so a file may be split anywhere: the reader of a split takes
    the groups that begin in it whole. Nothing is shuffled. Lines of other kinds are left out; what a type cannot hold is null.
    """
    groups = spark.read.option("lineSep", f"\n{tag}\t").text(path)
    lines = groups.select(F.split(F.regexp_replace("value", f"^{tag}\t", ""), "\n").alias("l")).where(F.col("l")[0] != "")

    def fields(line: Column, schema: str, skip: int) -> Column:
        parts = F.split(line, "\t")
        return F.struct(*(_plain(F.get(parts, F.lit(i + skip))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(T._parse_datatype_string(schema))))

    def rows(kind: str, schema: str) -> Column:
        return F.transform(F.filter("l", lambda x: F.startswith(x, F.lit(f"{kind}\t"))), lambda x: fields(x, schema, 1)).alias(kind)

    arrays = [rows(kind, schema) for kind, schema in children.items()]
    return lines.select(fields(F.col("l")[0], parent, 0).alias("p"), *arrays).select("p.*", *children)
