"""Tables of codes: tests by kind and names by code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CodeTable:
    """kinds: a name and the codes that have it; composites: a name and several kinds; ranges: a name and its first and last code. A missing code has no kind."""

    def __init__(self, kinds: dict[str, tuple], composites: dict[str, tuple[str, ...]] | None = None, ranges: dict[str, tuple] | None = None):
        self.kinds, self.composites, self.ranges = kinds, composites or {}, ranges or {}

    def has(self, code: Column, kind: str) -> Column:
        if kind in self.composites:
            return self.any_of(code, *self.composites[kind])
        if kind in self.ranges:
            return F.coalesce(code.between(*self.ranges[kind]), F.lit(False))
        return F.coalesce(code.isin(*self.kinds[kind]), F.lit(False))

    def any_of(self, code: Column, *kinds: str) -> Column:
        return F.coalesce(code.isin(*chain.from_iterable(self.kinds[k] for k in kinds)), F.lit(False))

    def name(self, code: Column) -> Column:
        """The kind of a code, null if it is in no kind."""
        return F.element_at(F.create_map(*(F.lit(x) for kind, codes in self.kinds.items() for code_ in codes for x in (code_, kind))), code)


def read_codes(spark: SparkSession, path: str, composites: dict[str, tuple[str, ...]] | None = None, ranges: dict[str, tuple] | None = None) -> CodeTable:
    """A table of whole-number codes from a file of code, tab and kind; for code books too large to be written here, like that of land uses."""
    rows = spark.read.csv(path, sep="\t", schema="code long, kind string").collect()
    kinds: dict[str, tuple] = {}
    for r in rows:
        kinds[r.kind] = (*kinds.get(r.kind, ()), r.code)
    return CodeTable(kinds, composites, ranges)


def named(df: DataFrame, code: str, table: CodeTable, name: str = "kind") -> DataFrame:
    """df with the name of each code, "unknown code" if it has none."""
    return df.withColumn(name, F.coalesce(table.name(F.col(code)), F.lit("unknown code")))


# The codes of the deed files.
DEEDS = CodeTable({
    "construction.loan": ("C",), "correction.deed": ("CD",), "final.judgement": ("F",), "grant.deed": ("G",), "lis.pendens": ("L",), "notice.of.default": ("N",), "quit.claim": ("Q",), "release": ("R",),
    "loan.assignment": ("S",), "deed.of.trust": ("T",), "foreclosure": ("U",), "multi.cnty.or.open.end.mortgage": ("X",), "nominal": ("Z",),
})
CATEGORIES = CodeTable({
    "arms.length.transaction": ("A",), "non.arms.length.purchase": ("B",), "non.arms.length.non.purchase": ("C",), "non.purchase": ("D",), "timeshare": ("E",), "notice.of.default": ("F",), "assignment": ("G",), "release": ("H",),
})
SALES = CodeTable({
    "confirmed": ("C",), "estimated": ("E",), "sale.price.full": ("F",), "sale.price.partial.1": ("L",), "not.of.public.record": ("N",), "sale.price.partial.2": ("P",), "lease": ("R",), "unknown": ("U",), "verified": ("V",),
}, {"sale.price.partial": ("sale.price.partial.1", "sale.price.partial.2")})
TRANSACTIONS = CodeTable({"resale": (1,), "refinance": (2,), "new.construction": (3,), "timeshare": (4,), "construction.loan": (6,), "seller.carryback": (7,), "nominal": (9,)})
# The property indicators of the parcel files.
PROPERTIES = CodeTable({
    "single.family.residence": (10,), "condominium": (11,), "duplex": (21,), "apartment": (22,), "hotel": (23,), "commercial": (24,), "retail": (25,), "service": (26,), "office.building": (27,), "warehouse": (28,),
    "financial.insitution": (29,), "hospital": (30,), "parking": (31,), "amusement": (32,), "industrial": (50,), "industrial.light": (51,), "industrial.heavy": (52,), "transport": (53,), "utilities": (54,), "agricultural": (70,),
    "vacant": (80,), "exempt": (90,), "missing": (0,),
}, {"any.industrial": ("industrial", "industrial.light", "industrial.heavy"), "retail.or.service": ("retail", "service")}, {})
# Codes that count as residential, and the range of schools (no universities) in the land uses.
RESIDENTIAL, SCHOOLS = (10, 11, 12, 22), (650, 665)


def any_residential(code: Column) -> Column:
    return F.coalesce(code.isin(*RESIDENTIAL), F.lit(False))


def any_school(code: Column) -> Column:
    return F.coalesce(code.between(*SCHOOLS), F.lit(False))
