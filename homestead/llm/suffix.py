"""Removal of every byte that a repeated string of a fixed length covers, with a distributed sparse suffix array.

Sorting a suffix for each byte isn't needed. Each window of 400 bytes names an anchor in its first 151 bytes, the place with
the smallest hash of 32 bytes there, so that equal windows name anchors at the same distance, and a run of
neighbouring windows shares one anchor. Only suffixes at anchors are kept, one in 75 bytes; suffixes whose
leading 250 bytes occur once are dropped after counting. If an anchor's whole surroundings (all bytes of its windows) occur
again, all of its windows are repeated. The others, at the edges of repeated passages, are range-partitioned with
sampled splitters by their leading bytes; each bucket is sorted by multikey quicksort, eight bytes a key, and common
prefixes of neighbours tell how far to the right suffixes agree, which with the bytes to the left decides each window.
Splitters never part suffixes with the same leading bytes, so nothing can agree across a bucket's boundary.
Leading bytes with more different surroundings than a bucket should hold are settled by counting hashes of the windows.

Anchors also tell of shorter repeats: a string of 270 bytes names an anchor in its first 151, wherever it stands, and the 120 bytes from there are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import plain_text, released, short_batches, small, table, written
from homestead.llm.shingles import _BACK, _POWER, mix

LENGTH, REACH, GRAM = 400, 150, 32
LEAD = LENGTH - REACH
#: Bytes from an anchor on that are counted as a short repeat.
SHORT = 120
#: Bytes that are hashed at once; windows of longer texts are taken in several turns.
CHUNK = 1 << 17
#: Leading bytes with more different surroundings are settled without a bucket.
BUCKET = 20_000
_LOW = np.uint64((1 << 20) - 1)


def prefix_sums(b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWER[: len(b)], dtype=np.uint64)])


def anchors(b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, lo, hi, lead, around, short) of a text: the windows from anchor - hi to anchor - lo share the anchor; hashes of the leading bytes, of all bytes of the windows and of the first SHORT bytes."""
    windows = len(b) - LENGTH + 1
    for at in range(0, max(windows, 0), CHUNK):
        n = min(CHUNK, windows - at)
        part = b[at : at + n + LENGTH - 1]
        sums = prefix_sums(part)
        with np.errstate(over="ignore"):
            grams = mix((sums[GRAM : n + REACH + GRAM] - sums[: n + REACH]) * _BACK[: n + REACH])
        low = (grams & ~_LOW) | np.arange(n + REACH, dtype=np.uint64)
        width = 1
        while width * 2 <= REACH + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = REACH + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        spot = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
        last = np.append(first[1:], n) - 1
        a = spot[first]
        with np.errstate(over="ignore"):
            lead = mix((sums[a + LEAD] - sums[a]) * _BACK[a])
            short = mix((sums[a + SHORT] - sums[a]) * _BACK[a])
            around = mix(mix((sums[last + LENGTH] - sums[first]) * _BACK[first]) + (a - first).astype(np.uint64) * np.uint64(1009) + (a - last).astype(np.uint64))
        yield a + at, a - last, a - first, lead.view(np.int64), around.view(np.int64), short.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key (a hash that with the id names a row's text) and text in bytes."""
    text = plain_text(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, sizes = [], np.zeros(len(batch), np.int64)
        for i, text in enumerate(batch["text"].tolist()):
            for part in anchors(np.frombuffer(text, np.uint8)):
                found.append(part)
                sizes[i] += len(part[0])
        if found:
            own = batch[["id", "text_key"]].iloc[np.repeat(np.arange(len(batch)), sizes)].reset_index(drop=True)
            columns = (np.concatenate(c) for c in zip(*found, strict=True))
            yield own.assign(**dict(zip(("anchor", "lo", "hi", "lead", "around", "short"), columns, strict=True))).astype({"id": "Int64"})


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each open suffix its bytes: to the left of the anchor, and from it on."""
    for batch in batches:
        rows = []
        for doc, key, text, spots in zip(batch["id"], batch["text_key"], batch["text"], batch["spots"], strict=True):
            for s in spots:
                a, lo, hi = s["anchor"], s["lo"], s["hi"]
                rows.append((doc, key, a, lo, hi, s["crowded"], s["settled"], text[a - hi : a], text[a : a + LENGTH - lo]))
        if rows:
            yield pd.DataFrame(rows, columns=["id", "text_key", "anchor", "lo", "hi", "crowded", "settled", "left", "suffix"]).astype({"id": "Int64"})


def multikey_sort(words: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned keys, leftmost key first: rows that are equal so far are parted by the next key."""
    order = np.arange(len(words))
    group = np.zeros(len(words), np.int64)
    for column in range(words.shape[1]):
        size = np.bincount(group)
        open_rows = np.flatnonzero(size[group] > 1)
        if not len(open_rows):
            break
        key = words[order[open_rows], column]
        by = np.lexsort((key, group[open_rows]))
        order[open_rows], key = order[open_rows[by]], key[by]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        inside = np.zeros(len(order), bool)
        inside[open_rows[1:]] = (key[1:] != key[:-1]) | (group[open_rows[1:]] != group[open_rows[:-1]])
        group = np.cumsum(new | inside) - 1
    return order


def settle(lefts: list[bytes], suffixes: list[bytes], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For the windows at distances 0 to REACH before each anchor: True if another suffix of the bucket has an equal one."""
    n = len(suffixes)
    repeated = np.zeros((n, REACH + 1), bool)
    raw = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in suffixes), np.uint8).reshape(n, LENGTH)
    order = multikey_sort(np.ascontiguousarray(raw).view(">u8").astype(np.uint64))
    differ = raw[order[1:]] != raw[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), LENGTH)
    length = np.array([len(s) for s in suffixes])[order]
    common = np.minimum(common, np.minimum(length[1:], length[:-1]))
    lo, hi = lo[order], hi[order]
    back = np.frombuffer(b"".join(s[::-1].ljust(REACH, b"\0") for s in lefts), np.uint8).reshape(n, REACH)[order]
    name = np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        if o:
            with np.errstate(over="ignore"):
                name = mix(name * np.uint64(31) + back[:, o - 1] + np.uint64(1))
        of = np.flatnonzero((lo <= o) & (o <= hi))
        if len(of) < 2:
            continue
        run = np.concatenate([[0], np.cumsum(common < LENGTH - o)])[of]
        by = np.lexsort((name[of], run))
        same = (run[by][1:] == run[by][:-1]) & (name[of][by][1:] == name[of][by][:-1])
        hit = np.zeros(len(of), bool)
        hit[1:] |= same
        hit[:-1] |= same
        repeated[order[of[by[hit]]], o] = True
    return repeated


def spans_of(repeated: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under runs of repeated windows."""
    padded = np.zeros((len(repeated), repeated.shape[1] + 2), np.int8)
    padded[:, 1:-1] = repeated
    step = np.diff(padded, axis=1)
    row, near = np.nonzero(step == 1)
    _, far = np.nonzero(step == -1)
    return row, anchor[row] - (far - 1), anchor[row] - near + LENGTH


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of repeated windows of suffixes that come in order of their leading bytes; suffixes of several leads are settled at once, those of one lead always together."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= BUCKET:
            others = np.flatnonzero((held["leading"] != held["leading"].iloc[-1]).to_numpy())
            if len(others):
                yield _settle_rows(held.iloc[: others[-1] + 1])
                held = held.iloc[others[-1] + 1 :].reset_index(drop=True)
    if held is not None and len(held):
        yield _settle_rows(held)
    released()


def _settle_rows(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.reset_index(drop=True)
    found = settle(rows["left"].tolist(), rows["suffix"].tolist(), rows["lo"].to_numpy(), rows["hi"].to_numpy())
    found[rows["settled"].to_numpy(bool)] = False
    row, start, end = spans_of(found, rows["anchor"].to_numpy())
    return pd.DataFrame({"id": rows["id"].astype("Int64").iloc[row].reset_index(drop=True), "text_key": rows["text_key"].to_numpy()[row], "start": start, "end": end})


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each window of crowded suffixes: two hashes of its bytes, and its place."""
    for batch in batches:
        for doc, key, a, lo, hi, left, suffix in zip(batch["id"], batch["text_key"], batch["anchor"], batch["lo"], batch["hi"], batch["left"], batch["suffix"], strict=True):
            text = np.frombuffer(left + suffix, np.uint8)
            first = np.arange(hi - lo + 1)
            hashes = []
            for t in (text, text ^ np.uint8(0x5A)):
                sums = prefix_sums(t)
                with np.errstate(over="ignore"):
                    hashes.append(mix((sums[first + LENGTH] - sums[first]) * _BACK[first]).view(np.int64))
            yield pd.DataFrame({"id": pd.Series([doc] * len(first), dtype="Int64"), "text_key": key, "start": a - hi + first, "h1": hashes[0], "h2": hashes[1]})


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of the anchors of all texts that hold a window: id, text_key, anchor, lo, hi, lead, around, short."""
    texts = _keyed(short_batches(docs), id_col, text_col)
    return written(texts.where(F.octet_length("text") >= LENGTH).mapInPandas(_anchor_rows, "id long, text_key long, anchor int, lo int, hi int, lead long, around long, short long"), "anchors")


def short_repeats(found: DataFrame) -> DataFrame:
    """id, text_key and n_short_repeats, the anchors of a text whose first SHORT bytes follow another anchor too."""
    often = found.groupBy("short").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("short")
    again = found.select("id", "text_key", "short").join(written(often, "shorts"), "short", "left_semi")
    return again.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n_short_repeats"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """id, text_key and spans (array of start, end in bytes; apart from each other, in order) of all texts with a repeated string. found: their anchors, if they are made."""
    texts = _keyed(short_batches(docs), id_col, text_col)
    found = (anchor_rows(docs, id_col, text_col) if found is None else found).drop("short")
    often = written(found.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lead"), "often")
    found = written(found.join(small(often), "lead", "left_semi"), "candidates")
    classes = found.groupBy("lead", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "text_key", "anchor", "lo", "hi")).alias("one"))
    classes = written(classes, "classes")
    leads = classes.groupBy("lead").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    again = written(classes.where("n > 1").select("lead", "around"), "again")
    spans = found.join(again, ["lead", "around"]).select("id", "text_key", (F.col("anchor") - F.col("hi")).alias("start"), (F.col("anchor") - F.col("lo") + LENGTH).alias("end"))
    unclear = classes.join(leads, "lead").select("one.*", (F.col("kinds") > BUCKET).alias("crowded"), (F.col("n") > 1).alias("settled"))
    spots = written(unclear.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "lo", "hi", "crowded", "settled")).alias("spots")), "unclear")
    spots = small(spots.withColumnsRenamed({"id": "of", "text_key": "of_key"}))
    with_spots = texts.dropDuplicates(["id", "text_key"]) if _repeats(texts) else texts
    with_spots = with_spots.join(spots, texts["id"].eqNullSafe(spots["of"]) & (texts["text_key"] == spots["of_key"])).select("id", "text_key", "text", "spots")
    bytes_of = with_spots.mapInPandas(_surroundings, "id long, text_key long, anchor int, lo int, hi int, crowded boolean, settled boolean, left binary, suffix binary")
    bytes_of = written(bytes_of, "surroundings")
    place = "id long, text_key long, start int, end int"
    buckets = bytes_of.where("NOT crowded").withColumn("leading", F.substring("suffix", 1, LEAD))
    spans = spans.unionByName(buckets.repartitionByRange("leading").sortWithinPartitions("leading").mapInPandas(_settled, place))
    crowded = bytes_of.where("crowded").mapInPandas(_window_hashes, "id long, text_key long, start int, h1 long, h2 long")
    if not bytes_of.where("crowded").isEmpty():
        crowded = written(crowded, "windows")
        twice = written(crowded.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
        spans = spans.unionByName(crowded.join(twice, ["h1", "h2"]).select("id", "text_key", "start", (F.col("start") + LENGTH).alias("end")))
    apart = F.pandas_udf(_apart, "array<struct<start: int, end: int>>")
    grouped = spans.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return grouped.withColumn("spans", apart("spans"))


def _repeats(texts: DataFrame) -> bool:
    return not texts.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def _apart(spans: pd.Series) -> pd.Series:
    return spans.map(lambda own: [{"start": s, "end": e} for s, e in _merged(own)])


def _cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, own in zip(texts, spans, strict=True):
        if text is None or own is None:
            rows.append((0, 0, None))
            continue
        merged, at, kept = [(s["start"], s["end"]) for s in own], 0, []
        for s, e in merged:
            kept.append(text[at:s])
            at = e
        rows.append((sum(e - s for s, e in merged), len(merged), b"".join([*kept, text[at:]])))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (bytes that stay), n_short_repeats (anchors that start a repeat of at least SHORT bytes).

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in the same text or another; texts
    are judged as they came. Null texts are empty; shorter texts stay whole. Ids may be null or occur again. Only
    the id and text columns are read.
    """
    found = anchor_rows(docs, id_col, text_col)
    marked = repeated_spans(docs, id_col, text_col, found).join(short_repeats(found).withColumnsRenamed({"id": "of", "text_key": "of_key"}), F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "full")
    marked = marked.select(F.coalesce("id", "of").alias("of"), F.coalesce("text_key", "of_key").alias("of_key"), "spans", "n_short_repeats")
    spans = written(marked, "spans")
    texts = _keyed(docs, id_col, text_col)
    both = texts.join(small(spans), texts["id"].eqNullSafe(spans["of"]) & (texts["text_key"] == spans["of_key"]), "left")
    cut_out = F.pandas_udf(_cut, "n_removed long, n_spans long, kept binary")
    cut = both.withColumn("cut", cut_out(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")))
    return cut.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "cut.n_removed", "cut.n_spans", F.coalesce("cut.kept", "text").alias("kept"), F.coalesce("n_short_repeats", F.lit(0)).alias("n_short_repeats"))



def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without repeated stretches of 400 bytes. Null texts are empty, repeated rows repeat each other, ids may be null; other columns are not read."""
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_short_repeats")
