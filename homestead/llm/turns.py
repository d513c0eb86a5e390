"""Conversations whose turns alternate: the cheapest edits that repair their structure.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. Turns
are kept (0), given the other role (3), deleted (4; blank and repeated turns must be) or inserted without text (3); a
turn that is cut off and not deleted costs 3 more. Of equally cheap repairs the one whose letters (D, I, K, R) come
first in ASCII order is taken.

The dynamic program goes from turn to turn over four states. One step is a macro: a run of insertions and then one edit
of the turn. The codes of macros are prefix-free and numbered in ASCII order, so two strings of edits compare like their
macros, and a layer need not hold strings: a state has its cost and the rank of its string among those of the layer.
Ranks of the next layer come from (rank, number of the macro). Parent pointers give the edits afterwards. Layers without
their common cost are few, so each step is looked up.

Turns are put in order by range partitions. A conversation that lies inside one partition is repaired there; one that
goes on in another partition (a very long one goes over many) is taken as one segment for each partition: segments
are solved from every state at once, the few numbers of all segments of a conversation are chained by the same rule, and
then the segments are decoded, each by itself. Only the digest of a repaired conversation has to read it in order: rows
are streamed through it, and none is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from homestead.llm.common import short_batches, table, written

#: White space of the rules.
SPACE = " \t\n\x0b\f\r"
KEEP, ROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States by the last role: none yet, system, user, assistant; the role that has to come next.
STATES, NEXT = "bsua", {"b": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: A state that costs so much more than another of its layer can't win: 3 for an insertion and 4 for a deletion bring that other one level.
HOPELESS = 12
CODES = {code: i for i, code in enumerate(sorted("I" * k + edit for k in range(3) for edit in "KRD"))}
FAULTS = ("", "truncated", "blank", "duplicate")
Layer = tuple  # for each state its cost and rank, or None


@lru_cache(None)
def moves(state: str, initial: str, fault: int) -> list[tuple[str, int, str]]:
    """Macros from a state over a turn: code, cost, next state."""
    out, now = [], state
    for k in range(3):
        run, paid = "I" * k, INSERT * k
        out.append((run + "D", paid + DELETE, now))
        if fault < 2:
            paid += CUT * fault
            if initial and (initial == NEXT[now] or initial == "s" and now == "b"):
                out.append((run + "K", paid + KEEP, initial))
            out.append((run + "R", paid + ROLE, NEXT[now]))
        now = NEXT[now]
    return out


def _next_layer(best: dict[str, tuple[tuple, str, object]]) -> tuple[Layer, int, dict]:
    """From the best (cost, rank, number) of each state with its parent: the layer without its common cost, that cost, the parents."""
    low = min(key[0] for key, _, _ in best.values())
    best = {s: b for s, b in best.items() if b[0][0] <= low + HOPELESS}
    rank = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
    layer = tuple((best[s][0][0] - low, rank[s]) if s in best else None for s in STATES)
    return layer, low, {s: (at, how) for s, (_, at, how) in best.items()}


@lru_cache(None)
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, dict]:
    """The layer after one more turn."""
    best: dict = {}
    for at, place in zip(STATES, layer, strict=True):
        for code, paid, to in moves(at, initial, fault) if place else ():
            key = (place[0] + paid, place[1], CODES[code])
            if to not in best or key < best[to][0]:
                best[to] = (key, at, code)
    return _next_layer(best)


def start(state: str = "b") -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def forward(symbols: Iterable[tuple[str, int]], layer: Layer) -> tuple[Layer, int, list[dict]]:
    """Last layer, its common cost and the parents of each layer."""
    total, parents = 0, []
    for initial, fault in symbols:
        layer, low, up = step(layer, initial, fault)
        total += low
        parents.append(up)
    return layer, total, parents


def backward(parents: list[dict], state: str) -> list[tuple[str, str]]:
    """State before each turn, and its macro, on the way that ends in a state."""
    out = []
    for up in reversed(parents):
        state, code = up[state]
        out.append((state, code))
    return out[::-1]


def closing(layer: Layer) -> tuple[str, str]:
    """The state in which a conversation ends, and the roles inserted after it."""
    tails = {"b": "", "a": "", "u": "a", "s": "ua"}
    ends = [((place[0] + INSERT * len(tails[s]), place[1]), s) for s, place in zip(STATES, layer, strict=True) if place]
    state = min(ends)[1]
    return state, tails[state]


def symbols(initials: Iterable[str], faults: Iterable[int], copies: Iterable[int]) -> Iterator[tuple[str, int]]:
    """What the program sees of rows; every further copy of a row is a repeated turn, and a row of which there is none is nothing."""
    for initial, fault, n in zip(initials, faults, copies, strict=True):
        if n:
            yield initial if initial in "sua" else "", fault
            for _ in range(n - 1):
                yield "", 3


def decoded(rows: list[tuple], way: list[tuple[str, str]], tail: str) -> list[tuple[str, str, str]]:
    """For each row the roles inserted before it, its edit and the roles inserted after it (the last row only); copies have no insertions of their own."""
    out, at = [], 0
    for row in rows:
        n = row[-1]
        inserted, edit = "", ""
        if n:
            state, code = way[at]
            for _ in code[:-1]:
                state = NEXT[state]
                inserted += state
            edit = {"R": NEXT[state]}.get(code[-1], code[-1])
            at += n
        out.append((inserted, edit, ""))
    out[-1] = (*out[-1][:2], tail)
    return out


# ----------------------------------------------------------------- rows


def ordered(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """conv, turn, role, text, copies, fault: one row for equal turns, with the first fault of each: 2 blank, 3 duplicate, 1 truncated, 0 none.

    conv_id and turn are whole numbers. A null role or text counts as one space. A turn is a duplicate if its role and text stand earlier in its conversation (by turn, nulls first;
    of one turn by role and text). Which occurrence is the first is found by aggregation, so a turn that half of a conversation repeats is no hot key.
    """
    own = [F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")]
    key = ["conv", "turn", "role", "digest"]
    base = rows.select(*own, (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256))).groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("text").alias("text"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = base.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min(place).alias("p"))
    first = first.select("conv", F.col("p.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("copies"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("first"))
    both = base.select(*key, "copies", "text", F.lit(0).alias("first")).unionByName(first)
    marked = both.groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("text").alias("text"), F.max("first").alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", 2).when(F.col("first") == 0, 3).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    return marked.select("conv", "turn", "role", "text", "copies", fault.cast("int").alias("fault"))


PASS = "conv long, part int, place long, turn long, role string, text string, copies long, fault int, inserted string, edit string, tail string, open boolean"
COLUMNS = [c.strip().split(" ")[0] for c in PASS.split(",")]
AT_ONCE = 4096


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == AT_ONCE:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    return df.astype({"conv": "Int64", "turn": "Int64", "place": "int64", "part": "int32", "copies": "int64", "fault": "int32", "open": "bool"})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of conversations inside this partition; the rows of its first and last one, which may go on elsewhere, stay open."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        for b in batches:
            convs, turns = (b[c].astype("Int64").astype(object).where(b[c].notna(), None) for c in ("conv", "turn"))
            yield from zip(convs, turns, b["role"], b["text"], b["fault"].tolist(), b["copies"].tolist(), strict=True)

    def done(own: list[tuple]) -> Iterator[tuple]:
        layer, _, parents = forward(symbols((r[2][:1] for r in own), (r[4] for r in own), (r[5] for r in own)), start())
        state, tail = closing(layer)
        for i, (r, e) in enumerate(zip(own, decoded(own, backward(parents, state), tail), strict=True)):
            yield r[0], part, i, r[1], r[2], r[3], r[5], r[4], *e, False

    def left(own: Iterable[tuple], at: int) -> Iterator[tuple]:
        for i, r in enumerate(own, at):
            yield r[0], part, i, r[1], r[2], r[3], r[5], r[4], "", "", "", True

    def out() -> Iterator[tuple]:
        waiting: list[tuple] = []
        for i, (_, group) in enumerate(groupby(rows(), lambda r: (r[0] is not None, r[0]))):
            if not i:  # streamed: it may fill the partition
                yield from left(group, 0)
                continue
            yield from done(waiting) if waiting else ()
            waiting = list(group)
        yield from left(waiting, 0)

    return _frames(out())


def _summed(df: pd.DataFrame) -> pd.DataFrame:
    """Of one segment: cost and rank of every way from a state to a state."""
    seen = list(symbols((r[:1] for r in df["role"]), df["fault"].tolist(), df["copies"].tolist()))
    costs, ranks = [], []
    for entry in STATES:
        layer, total, _ = forward(seen, start(entry))
        costs += [place[0] + total if place else None for place in layer]
        ranks += [place[1] if place else None for place in layer]
    conv = df["conv"].iloc[0]
    return pd.DataFrame({"conv": pd.array([None if pd.isna(conv) else int(conv)], "Int64"), "part": [int(df["part"].iloc[0])], "costs": [costs], "ranks": [ranks]})


def _chained(df: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation: the state before and after each of its segments, and the roles inserted at its end."""
    df = df.sort_values("part")
    layer, parents = start(), []
    for costs, ranks in zip(df["costs"], df["ranks"], strict=True):
        best: dict = {}
        for i, (at, place) in enumerate(zip(STATES, layer, strict=True)):
            for j, to in enumerate(STATES) if place else ():
                cost = costs[4 * i + j]
                if cost is not None and cost == cost:
                    key = (place[0] + cost, place[1], ranks[4 * i + j])
                    if to not in best or key < best[to][0]:
                        best[to] = (key, at, to)
        layer, _, up = _next_layer(best)
        parents.append(up)
    state, tail = closing(layer)
    way = backward(parents, state)
    n = len(df)
    return pd.DataFrame({"conv": df["conv"].astype("Int64").to_numpy(), "part": df["part"].astype("int32").to_numpy(), "entry": [w[0] for w in way], "leave": [w[1] for w in way], "end": [""] * (n - 1) + [tail]})


def _decoded(df: pd.DataFrame) -> pd.DataFrame:
    """Edits of one segment whose states before and after are known."""
    df = df.sort_values("place")
    _, _, parents = forward(symbols((r[:1] for r in df["role"]), df["fault"].tolist(), df["copies"].tolist()), start(df["entry"].iloc[0]))
    rows = [(n,) for n in df["copies"].tolist()]
    edits = decoded(rows, backward(parents, df["leave"].iloc[0]), df["end"].iloc[0])
    df["inserted"], df["edit"], df["tail"] = zip(*edits, strict=True)
    return df[COLUMNS].astype({"conv": "Int64", "turn": "Int64"})


def edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of `ordered` rows, in two frames: of conversations inside a partition, in order there, and of those that go on in others.

    conv, part and place (their order), turn, role, text, copies (of which all but the first are deleted), fault, inserted (initials of the roles
    inserted before), edit (K kept, D deleted, u or a: given that role, empty: no row), tail (inserted after the last).
    """
    lined = short_batches(rows.repartitionByRange(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")).sortWithinPartitions("conv", "turn", "role", "text")
    found = written(lined.select("conv", "turn", "role", "text", "copies", "fault").mapInPandas(_whole, PASS), "turns")
    opened = found.where("open")
    segments = written(opened.groupBy("conv", "part").applyInPandas(_summed, "conv long, part int, costs array<int>, ranks array<int>"), "segments")
    ways = segments.groupBy("conv").applyInPandas(_chained, "conv long, part int, entry string, leave string, end string")
    ways = ways.select(F.col("conv").alias("c"), F.col("part").alias("p"), "entry", "leave", "end")
    known = opened.join(ways, opened["conv"].eqNullSafe(ways["c"]) & (opened["part"] == ways["p"])).drop("c", "p")
    return found.where("NOT open"), known.groupBy("conv", "part").applyInPandas(_decoded, PASS)


# ----------------------------------------------------------------- reports


REPORT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation; its rows come one after the other, in order."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            convs, turns = (b[c].astype("Int64").astype(object).where(b[c].notna(), None) for c in ("conv", "turn"))
            yield from zip(convs, turns, b["role"], b["text"], b["copies"].tolist(), b["fault"].tolist(), b["inserted"], b["edit"], b["tail"], strict=True)

    def report(conv, own: Iterator[tuple]) -> tuple:
        count, sha, lines = [0, 0, 0, 0], hashlib.sha256(), 0
        illegal = cost = distinct = 0
        last, low, high, before, audit = None, None, None, None, []

        def put(role: str, text: str) -> None:
            nonlocal lines
            sha.update(("\n" if lines else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1

        for _, turn, role, text, n, fault, inserted, edit, tail in own:
            if n:
                if turn is not None:
                    distinct += turn != last
                    low, high, last = turn if low is None else low, turn, turn
                count[fault] += 1
                count[2 if fault == 2 else 3] += n - 1
                initial = role[:1]
                illegal += (before is not None and before + initial not in LEGAL) + n - 1
                before = initial
                for r in inserted:
                    put(ROLES[r], "")
                audit.append("I" * len(inserted) + ("R" if edit in ROLES else edit) + "D" * (n - 1))
                cost += INSERT * len(inserted) + DELETE * (n - 1)
                if edit == "D":
                    cost += DELETE
                else:
                    cost += CUT * (fault == 1) + ROLE * (edit in ROLES)
                    put(ROLES.get(edit, role), text)
            for r in tail:
                put(ROLES[r], "")
            audit.append("I" * len(tail))
            cost += INSERT * len(tail)
        gaps = 0 if low is None else high - low + 1 - distinct
        return conv, gaps, count[2], count[3], count[1], illegal, cost, "".join(audit), sha.hexdigest()

    held: list[tuple] = []
    names = [c.strip().split(" ")[0] for c in REPORT.split(",")]
    for (_, conv), own in groupby(rows(), lambda r: (r[0] is not None, r[0])):
        held.append(report(conv, own))
        if len(held) == AT_ONCE:
            yield pd.DataFrame(held, columns=names).astype({"conv": "Int64"})
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype({"conv": "Int64"})


def reports(whole: DataFrame, spread: DataFrame) -> DataFrame:
    """conv with its gaps, faults, illegal neighbours, cost, audit and the digest of its repaired turns, from the two frames of `edits`.

    A digest of a whole conversation can't be put together from digests of parts, so one task streams a conversation's rows; it holds its letters only.
    """
    gathered = spread.repartition("conv").sortWithinPartitions("conv", "part", "place")
    return whole.mapInPandas(_reports, REPORT).unionByName(gathered.mapInPandas(_reports, REPORT))


def repaired(whole: DataFrame, spread: DataFrame) -> DataFrame:
    """conv, part, place, nth, role, text: the turns of repaired conversations in order, from the two frames of `edits`."""
    all_rows = whole.unionByName(spread)
    roles = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    turns = lambda c: F.transform(F.filter(F.split(c, ""), lambda r: r != ""), lambda r: F.struct(roles[r].alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("edit").isin("K", *ROLES), F.array(F.struct(F.coalesce(roles[F.col("edit")], F.col("role")).alias("role"), F.col("text").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return all_rows.select("conv", "part", "place", F.posexplode(F.concat(turns(F.col("inserted")), own, turns(F.col("tail")))).alias("nth", "t")).select("conv", "part", "place", "nth", "t.*")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after a damage that depends on conv_id and turn: dropped (0 copies), emptied, without stops, repeated, user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all damaged conversations.

    Null roles and texts are one space; a role that is empty or starts with none of s, u, a can't be kept. Turns of one number are in order of
    role and text. A null conv_id is a conversation. Every conv_id has a row, also one that lost all its turns. Of extra columns nothing is read.
    """
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return reports(*edits(ordered(rows, copies=F.col("copies")))).withColumnRenamed("conv", "conv_id")


# The same rows in SQL: strings instead of ranks, all macros of a step, the least of each state.
_OTHER = "CASE v.q WHEN 'u' THEN 'a' ELSE 'u' END"
_NAME = "CASE v.q WHEN 'u' THEN 'assistant:' ELSE 'user:' END"
_RUNS = f"list_transform(list_transform([{{w}}], lambda p: p || {{one}}), lambda p: p || {{one}})[1]".replace(
    "{one}", f"list_transform(p, lambda v: {{{{'q': {_OTHER}, 'c': v.c + 3, 'e': v.e || 'I', 'r': v.r || [{_NAME}]}}}})"
)
_CUT = "v.c + CASE y.f WHEN 't' THEN 3 ELSE 0 END"
_EDITS = f"""flatten(list_transform({_RUNS.format(w='acc.way')}, lambda v: [
      {{'q': v.q, 'c': v.c + 4, 'e': v.e || 'D', 'r': v.r}},
      CASE WHEN y.f IN ('o', 't') AND (y.i = {_OTHER} OR y.i = 's' AND v.q = 'b') THEN {{'q': y.i, 'c': {_CUT}, 'e': v.e || 'K', 'r': v.r || [y.x]}} END,
      CASE WHEN y.f IN ('o', 't') THEN {{'q': {_OTHER}, 'c': {_CUT} + 3, 'e': v.e || 'R', 'r': v.r || [{_NAME} || y.t]}} END]))"""
_LEAST = ", ".join(f"list_sort(list_transform(list_filter(z, lambda v: v.q = '{s}'), lambda v: {{'c': v.c, 'e': v.e, 'q': v.q, 'r': v.r}}))[1]" for s in STATES)
_WAY = "STRUCT(c INTEGER, e VARCHAR, q VARCHAR, r VARCHAR[])[]"
SQL = f"""
WITH crc AS (
  SELECT list(CAST(list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS t FROM range(256) AS r(i)),
own AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM own WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault FROM seen),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '-' END, 'f': fault, 'x': role || ':' || text, 't': text, 'way': CAST([] AS {_WAY})}} ORDER BY place) AS turns
  FROM faulty GROUP BY conv_id),
solved AS (
  SELECT *, list_reduce([{{'i': '', 'f': '', 'x': '', 't': '', 'way': CAST([{{'c': 0, 'e': '', 'q': 'b', 'r': []}}] AS {_WAY})}}] || turns, lambda acc, y: {{'i': '', 'f': '', 'x': '', 't': '',
    'way': list_filter(list_transform([list_filter({_EDITS}, lambda v: v IS NOT NULL)], lambda z: [{_LEAST}])[1], lambda v: v IS NOT NULL)}}).way AS ways FROM grouped),
ended AS (SELECT *, list_sort(list_transform(list_filter({_RUNS.format(w='ways')}, lambda v: v.q IN ('b', 'a')), lambda v: {{'c': v.c, 'e': v.e, 'r': v.r}}))[1] AS best FROM solved)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
