"""Documents whose sets of word shingles have a Jaccard similarity of at least 0.8, and the groups they form.

Two sets that similar differ in at most a ninth of their sizes' sum. The universe of shingles is therefore partitioned
by hash into more segments than a size band allows differences, and each set is indexed by the hashes of its subsets,
one for each segment. By the pigeonhole principle a set whose n subsets may differ in d shingles shares n - d of them at
least with every similar set, its need. Where d is so large that no need is left, the one-deletion neighbourhoods of
the subsets are indexed too, in which subsets that differ in one shingle meet, and, for very small sets, empty subsets.

The cost of a subset is the number of sets in its bucket. A set that has fewer subsets in common with anyone than it needs
is similar to none and goes; one that stays pays for its cheapest subsets only, as many as it takes for similar sets
to meet in one of them, and for none of the dear ones, which hold passages that many documents share.

What meets in a bucket is not compared pair by pair: all are compared with the first one, exactly, and
components are formed. Sets that still meet enough sets of other components are partitioned once more as finely as can be, one
shingle a segment, of which each set needs only its rarest ones; only pairs of different components that meet there are
compared. So groups of thousands of copies cost a row for each, and passages that many documents share lead to no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homestead.llm.common import free_name, plain_text, released, shared_dir, short_batches, small, table, written
from homestead.llm.graph import components
from homestead.llm.shingles import mix, shingle_set

#: Similarity as a ratio of whole numbers; words of a shingle.
PER, OF, WORDS = 80, 100, 5
#: Ratio of the bounds of a size band; share of segments more than differences need.
BAND, SPARE = 1.5, 0.02
#: Rounds in which sets without enough common subsets go; each leaves others without, and any number gives the same links.
ROUNDS = 2
#: Parities of so many parts of a set, in words of 64 bits; sets differ in at least as many shingles as parities.
PARITIES, FEW_PARITIES = 64, 4
MEMBER, SUBSET = 0, 1
_SIGS = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("tag", pa.int64()), ("doc_id", pa.int64())])
_FOUND = pa.schema([("kind", pa.int32()), ("sig", pa.int64()), ("cls", pa.int64()), ("tag", pa.int64())])


def set_class(s: np.ndarray) -> int:
    """A hash of a whole set; equal sets have the same."""
    with np.errstate(over="ignore"):
        both = np.array([np.bitwise_xor.reduce(s), np.add.reduce(mix(s)), np.uint64(len(s))], np.uint64)
        return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:])[0].astype(np.int64))


def signatures(s: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(below, need, hashes) of the subsets of a set in its own size band (below 0) and, if smaller sets may be similar, in the band below (1).

    A similar set shares need of the hashes at least, if that is over 1; else one.
    """
    size, out = len(s), []
    band = int(np.log(size) / np.log(BAND) + 1e-9)
    mixed = mix(s)
    for below, b in enumerate((band, band - 1)):
        top = BAND ** (b + 1)
        if below and size * PER > top * OF:
            continue
        most = int(top * (PER + OF) / PER * (OF - PER) / (OF + PER)) + 1
        m = most + 1 + int(SPARE * most)
        where = ((s >> np.uint64(17)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        counts = np.bincount(where, minlength=m)
        full = np.flatnonzero(counts)
        ends = np.cumsum(counts)[full]
        other = min(size, top) if below else size * OF / PER
        differ = min(most, int((size + other) * (OF - PER) / (OF + PER) + 1e-9))
        with np.errstate(over="ignore"):
            salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((b + 2) << 40))
            sums = np.add.reduceat(mixed[order], ends - counts[full]) + salt[full]
            hashes = [mix(sums)]
            if len(full) <= differ:
                inside = np.repeat(counts[full] >= 2, counts[full])
                hashes.append(mix((np.repeat(sums, counts[full]) - mixed[order])[inside]))
                if len(full) + int((counts >= 2).sum()) <= differ:
                    hashes.append(mix(salt[counts == 0] + np.uint64(1)))
        out.append((below, max(1, len(full) - differ), np.unique(np.concatenate(hashes))))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (tag: its shingles, negative or 0), and one for each hash of its subsets (tag: size, need, band) unless the task had that set before."""
    seen: set[int] = set()
    for batch in batches:
        docs, texts = batch.column("id").to_pylist(), batch.column("text")
        for at in range(0, len(docs), 500):
            members, own = [], []
            for doc, text in zip(docs[at : at + 500], texts[at : at + 500], strict=True):
                s = shingle_set(text.as_buffer().to_pybytes() if text.as_buffer() else b"")
                cls = set_class(s) if len(s) else None
                members.append((cls, -len(s), doc))
                if len(s) and cls not in seen:
                    seen.add(cls)
                    own += [(hashes.view(np.int64), cls, len(s) << 32 | need << 1 | below) for below, need, hashes in signatures(s)]
            spread = mix(np.array([(d or 0) & (1 << 63) - 1 for _, _, d in members], np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spread), *(pa.array(c, pa.int64()) for c in zip(*members, strict=True))], schema=_SIGS)
            if own:
                lengths = [len(k) for k, _, _ in own]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in own])), *(pa.array(np.repeat(np.array([o[i] for o in own], np.int64), lengths)) for i in (1, 2)), pa.nulls(sum(lengths), pa.int64())], schema=_SIGS)
    released()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they are, and the subsets that several sets have. Rows come in order of (sig, cls); of a bucket only its last row is held."""
    held, known = np.empty((3, 0), np.int64), False  # the last row, and whether its bucket has another
    for batch in batches:
        tag = batch.column("tag").to_numpy()
        subset = tag > 0
        docs = batch.filter(pa.array(~subset))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(docs.num_rows, MEMBER, np.int32)), docs.column("doc_id"), docs.column("cls"), docs.column("tag")], schema=_FOUND)
        if not subset.any():
            continue
        rows = np.concatenate([held, np.stack([batch.column("sig").to_numpy()[subset], batch.column("cls").fill_null(0).to_numpy()[subset], tag[subset]])], axis=1)
        same = rows[0, 1:] == rows[0, :-1]
        new = np.concatenate([[True], ~(same & (rows[1, 1:] == rows[1, :-1]))])
        rows = rows[:, new]
        same = rows[0, 1:] == rows[0, :-1]
        shared = np.concatenate([[known], same]) | np.concatenate([same, [False]])
        held, known = rows[:, -1:].copy(), bool(shared[-1])
        out = rows[:, :-1][:, shared[:-1]]
        if out.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(out.shape[1], SUBSET, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in out)], schema=_FOUND)
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([SUBSET], np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in held)], schema=_FOUND)
    released()


def parities(s: np.ndarray) -> np.ndarray:
    """Whether each of PARITIES * 64 parts of the universe holds an odd number of the set's shingles."""
    odd = np.bincount(((s >> np.uint64(40)) % np.uint64(PARITIES * 64)).astype(np.int64), minlength=PARITIES * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls, set and parities of documents."""
    for batch in batches:
        rows = [shingle_set(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        rows = [r for r in rows if len(r)]
        odd = [parities(r) for r in rows]
        few = [np.bitwise_xor.reduce(o.reshape(-1, FEW_PARITIES), axis=0) for o in odd]
        yield pa.RecordBatch.from_arrays([pa.array([set_class(r) for r in rows], pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(few, pa.list_(pa.int64())), pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["cls", "n", "odd", "few", "items"])


def may_be_similar(odd: str, words: int) -> str:
    """Of sets a and b with columns {x}_n and {x}_<odd>: False only if their parities differ in more places than similar sets may."""
    differ = " + ".join(f"bit_count(a_{odd}[{i}] ^ b_{odd}[{i}])" for i in range(words))
    return f"({differ}) * {OF + PER} <= (a_n + b_n) * {OF - PER}"


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar: those that sizes and parities leave, by their whole sets."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"), F.col("odd").alias(f"{x}_odd"))
    close = f"{OF} * least(a_n, b_n) >= {PER} * greatest(a_n, b_n) AND {may_be_similar('odd', PARITIES)}"
    near = written(pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b"), "near")
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("b_items")).join(small(near), "b")
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("a_items")).join(small(near.select("a").distinct()), "a", "left_semi")
    both = right.join(left, "a").withColumn("common", F.size(F.array_intersect("a_items", "b_items")))
    return both.where(OF * F.col("common") >= PER * (F.size("a_items") + F.size("b_items") - F.col("common"))).select("a", "b")


def meetings(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that share one of the shingles that each needs to share.

    Of a set of n shingles any similar one shares eight of ten, so one of its rarest n - ceil(0.8 n) + 1 at least.
    """
    rows = sets.select("cls", "n", F.explode("items").alias("item"))
    often = written(rows.groupBy("item").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    shared = rows.join(often, "item").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("by_df"))
    need = F.col("n") - F.ceil(F.col("n") * PER / OF) + 1
    alone = F.col("n") - F.size("by_df")
    first = F.slice("by_df", 1, F.greatest((need - alone).cast("int"), F.lit(0)))
    kept = shared.select("cls", "n", alone.alias("alone"), F.posexplode(first).alias("at", "e")).select("cls", "n", (F.col("alone") + F.col("at") + 1).alias("place"), F.col("e.item").alias("item"))
    kept = kept.join(sets.select("cls", "few"), "cls")
    kept = written(kept.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "rarest")
    left, right = (kept.select(F.col("cls").alias(x), F.col("n").alias(f"{x}_n"), F.col("component").alias(f"{x}_c"), F.col("place").alias(f"{x}_at"), F.col("few").alias(f"{x}_few"), "item") for x in ("a", "b"))
    # of sets of these two sizes so many shingles must be common; one of the common ones is so early in either order
    common = f"(({PER} * (a_n + b_n) + {PER + OF - 1}) div {PER + OF})"
    early = f"a_at <= a_n - {common} + 1 AND b_at <= b_n - {common} + 1"
    near = left.join(right, "item").where(f"a < b AND a_c <> b_c AND {OF} * least(a_n, b_n) >= {PER} * greatest(a_n, b_n) AND {early} AND {may_be_similar('few', FEW_PARITIES)}")
    return near.select("a", "b").distinct()


def enough(subsets: DataFrame) -> DataFrame:
    """subsets (sig, cls, need, below) without those of sets that have fewer of them than they need."""
    counted = subsets.groupBy("cls", "below").agg(F.count(F.lit(1)).alias("n"), F.any_value("need").alias("least"))
    return subsets.join(counted.where("n >= least").select("cls", "below"), ["cls", "below"], "left_semi")


def common(subsets: DataFrame, by: str = "cls") -> DataFrame:
    """subsets with first (the smallest `by`) and cost (the number of rows) of the bucket, of buckets that hold several."""
    buckets = subsets.groupBy("sig").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count(F.lit(1)).alias("cost"))
    return subsets.drop("first", "cost").join(buckets.where("first <> last").drop("last"), "sig")


def allocated(subsets: DataFrame) -> DataFrame:
    """Of each set's subsets the cheapest, as many as it takes for any similar set to meet it in one of them."""
    own = Window.partitionBy("cls", "below")
    ranked = subsets.select("*", F.count(F.lit(1)).over(own).alias("n"), F.row_number().over(own.orderBy("cost", "sig")).alias("place"))
    return ranked.where("place <= n - need + 1").drop("n", "place")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, cls (hash of its set), component, component_id (its smallest id).

    A null text is empty; a document without words has no set, no class and no links. Ids may be null or occur again; a
    null id is never a component's id unless it has no other. Only the id and text columns are read.
    """
    spark = short_batches(docs).sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), plain_text(F.col(text_col)).cast("binary").alias("text"))
    found = texts.mapInArrow(_index, "sig long, cls long, tag long, doc_id long").repartition("sig").sortWithinPartitions("sig", "cls")
    path = shared_dir(spark, "met")
    found.mapInArrow(_meet, "kind int, sig long, cls long, tag long").write.partitionBy("kind").parquet(path)
    read = lambda kind: spark.read.schema("sig long, cls long, tag long, kind int").option("basePath", path).parquet(path).where(F.col("kind") == kind).drop("kind")
    members = read(MEMBER).select(F.col("sig").alias("id"), "cls", (-F.col("tag")).cast("int").alias("n_shingles"))
    subsets = read(SUBSET).select("sig", "cls", F.shiftright("tag", 1).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("need"), F.col("tag").bitwiseAND(1).cast("int").alias("below"))
    for _ in range(ROUNDS):
        subsets = written(common(enough(subsets)), "subsets")
    chosen = common(allocated(enough(subsets)))
    stars = written(chosen.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct(), "stars")
    sets = _sets_of(texts, members, subsets.select("cls").distinct())
    links = written(linked(stars, sets), "links")
    labels = components(links)
    named = subsets.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    for _ in range(ROUNDS):
        named = written(enough(common(named, by="component")), "mixed")
    named = written(common(allocated(named), by="component").select("cls").distinct(), "open")
    more = written(linked(written(meetings(sets.join(named, "cls", "left_semi"), labels), "meetings"), sets), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    placed = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("id", "n_shingles", "cls", F.coalesce("component", "cls").alias("component"))
    placed = written(placed, "placed")
    least = written(placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id")), "least")
    return placed.join(least, "component", "left").select("id", "n_shingles", "cls", "component", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets_of(texts: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of the classes, each from the text of one of its documents."""
    one = members.where("cls IS NOT NULL").join(classes, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct("id")).alias("one"))
    one = written(one.select(F.col("one.id").alias("one_id")).distinct(), "needed")
    some = texts.join(small(one), texts["id"].eqNullSafe(one["one_id"]), "left_semi")
    sets = written(some.mapInArrow(_sets, "cls long, n int, odd array<long>, few array<long>, items array<long>"), "sets")
    n, distinct = sets.agg(F.count(F.lit(1)), F.count_distinct("cls")).first()
    return sets if n == distinct else written(sets.dropDuplicates(["cls"]), "sets")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of each group only the document with the smallest id; same columns.

    Rows with one id are one document. A row without id goes if its group has a document with an id; of a group
    without any id the rows of one set stay.
    """
    rows = written(groups(docs, id_col, text_col).where("component IS NOT NULL"), "placed")
    gone, ident = free_name(docs, "gone"), docs[id_col].cast("long")
    gone_ids = written(rows.where("id <> component_id").select(F.col("id").alias(gone)).distinct(), "gone")
    left = docs.join(small(gone_ids), ident == gone_ids[gone], "left_anti")
    gone_sets = written(rows.where("id IS NULL AND (component_id IS NOT NULL OR cls <> component)").select(F.col("cls").alias(gone)).distinct(), "gone")
    if gone_sets.isEmpty():
        return left
    own = docs.where(ident.isNull())
    own = own.join(small(gone_sets), F.pandas_udf(class_of, "long")(plain_text(F.col(text_col)).cast("binary")) == gone_sets[gone], "left_anti")
    return left.where(ident.isNotNull()).unionByName(own)


def class_of(texts: pd.Series) -> pd.Series:
    """The hash of each text's set; null without words."""
    sets = [shingle_set(t) for t in texts]
    return pd.Series([set_class(s) if len(s) else None for s in sets], dtype="Int64")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar documents. A document without words is linked with nothing, rows of one text are one class, ids may be null or occur again; other columns are not read."""
    rows = groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b USING (item) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM sets UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
