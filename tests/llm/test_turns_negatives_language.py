"""Turn repair, hard negatives and languages against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homestead.llm import language, negatives, turns

SF = "/root/testdata/sf0.001"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("cost", T.StringType())])


def plain_damage(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
    return [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def plain_repair(rows):
    """Every string of edits whose roles may become right, the cheapest first by cost, then letters: no ranks, no pointers, up to three insertions anywhere."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}
    for (_, role, text), fault in [*zip(rows, faults, strict=True), ((None, None, None), None)]:
        new = {}
        for state, (cost, audit, out) in best.items():
            for _ in range(4):
                ways = [(state, cost, audit, out)] if role is None else [(state, cost + 4, audit + "D", out)]
                if role is not None and fault in ("", "truncated"):
                    more = 3 * (fault == "truncated")
                    if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                        ways.append((role[:1], cost + more, audit + "K", [*out, f"{role}:{text}"]))
                    ways.append((NEXT[state], cost + 3 + more, audit + "R", [*out, f"{ROLE[NEXT[state]]}:{text}"]))
                for s, *w in ways:
                    if s not in new or tuple(w[:2]) < tuple(new[s][:2]):
                        new[s] = tuple(w)
                state = NEXT[state]
                cost, audit, out = cost + 3, audit + "I", [*out, f"{ROLE[state]}:"]
        best = new
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


@pytest.fixture(scope="module")
def odd_turns():
    lot = random.Random(5)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(lot.choice([1, 2, 5, 9])):
            role = lot.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            rows.append((conv, lot.choice([turn, turn, turn, 3, None, -2]), role, lot.choice(["Yes.", "Well?", "cut of", "", " \x0b\n", None, "é…", f"No {turn}!", "a.\r\n"]), "x"))
    rows += [(100, i, "user" if i % 2 else "assistant", f"t{i}." if i % 7 else "same", "x") for i in range(400)]  # goes over many partitions
    rows += [(101, 0, "user", "again.", "x")] * 50
    rows += [(102, None, None, None, None)] * 3
    return rows


def test_repairs_are_the_cheapest(spark, odd_turns):
    df = spark.createDataFrame(odd_turns, TURNS)
    plain: dict = {}
    for conv, *rest in odd_turns:
        plain.setdefault(conv, []).extend(plain_damage(conv, *rest[:3]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turns.edits(turns.ordered(turns.damaged(df), copies=F.col("copies")))
        assert found[1].select("conv").distinct().count() > 3 and found[0].select("conv").distinct().count() > 3  # both ways are used
        assert found[1].where("conv = 100").select("part").distinct().count() > 1
        got = {r[0]: tuple(r[1:]) for r in turns.reports(*found).collect()}
        made = turns.repaired(*found).orderBy("part", "place", "nth").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == set(plain)
    for conv, rows in plain.items():
        assert got[conv] == plain_repair(rows), conv
        text = "\n".join(f"{r['role']}:{r['text']}" for r in made if r["conv"] == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in made if r["conv"] == conv))


def test_no_turns_at_all(spark):
    df = spark.createDataFrame([], TURNS)
    assert turns.reports(*turns.edits(turns.ordered(turns.damaged(df), copies=F.col("copies")))).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = turns.reports(*turns.edits(turns.ordered(turns.damaged(spark.createDataFrame([(lost, 1, "user", "x.", None)], TURNS)), copies=F.col("copies")))).first()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_segments_chain_like_one_piece():
    """Costs and ranks of two halves give the way of the whole, whatever the cut."""
    lot = random.Random(3)
    for _ in range(300):
        seen = [(lot.choice(["u", "a", "s", ""]), lot.choice([0, 0, 0, 1, 2, 3])) for _ in range(lot.randint(2, 9))]
        cut = lot.randint(1, len(seen) - 1)
        parts = []
        for i, piece in enumerate((seen[:cut], seen[cut:])):
            df = pd.DataFrame({"conv": 1, "part": i, "role": [a for a, _ in piece], "fault": [f for _, f in piece], "copies": 1})
            parts.append(turns._summed(df))
        ways = turns._chained(pd.concat(parts))
        audit = ""
        for way, piece in zip(ways.itertuples(), (seen[:cut], seen[cut:]), strict=True):
            _, _, parents = turns.forward(piece, turns.start(way.entry))
            audit += "".join(code for _, code in turns.backward(parents, way.leave)) + "I" * len(way.end)
        layer, _, parents = turns.forward(seen, turns.start())
        state, tail = turns.closing(layer)
        assert audit == "".join(code for _, code in turns.backward(parents, state)) + "I" * len(tail)


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def plain_negatives(rows):
    own = []
    for i, v, label, _ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((i, [int(max(-(1 << 20), min((1 << 20) - 1, np.floor(256 * float(np.float32(x)))))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, a, label in own:
        if i % 100 == 0:
            best = sorted((-dot(a, v), j) for j, v, k in own if k == label and j != i)[:5]
            for p, pid in best:
                far = sorted((-dot(a, v), j) for j, v, k in own if k != label and j != i and 30 * -p <= 100 * dot(a, v) <= 90 * -p)[:10]
                out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(far, 1)]
    return sorted(out)


def test_hard_negatives_with_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6).round(1)], int(rng.integers(0, 10)), "s") for i in range(600)]  # rounding makes ties
    rows += [(700, None, 1, "s"), (800, [1.0, None], 1, "s"), (900, [float("nan")] * 6, 1, "s"), (1000, [float("inf")] * 6, 2, "s"), (1100, [0.5] * 6, None, "s"), (None, [0.5] * 6, 1, "s")]
    rows += [(1200, [], 3, "s"), (1201, [0.5, 0.25], 3, "s"), (1202, [0.5] * 9, 4, "s"), (1300, [1e30, -1e30], 4, "s"), (100, rows[100][1], rows[100][2], "s"), (17, rows[17][1], rows[17][2], "s")]
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = negatives.op11_hard_negatives(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    old, negatives.BLOCK_ROWS = negatives.BLOCK_ROWS, 3  # the same in blocks
    try:
        assert sorted(map(tuple, negatives.op11_hard_negatives(spark, str(tmp_path)).collect())) == plain_negatives(rows)
    finally:
        negatives.BLOCK_ROWS = old
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert negatives.op11_hard_negatives(spark, str(tmp_path / "none")).count() == 0


def test_planes_drop_most_rows_and_keep_the_scores():
    rng = np.random.default_rng(2)
    a, v = rng.integers(-90, 90, (3, 32)).astype(float), rng.integers(-90, 90, (5000, 32))
    left = []

    def qualify(alive, low, high):
        exact = a @ v.T
        if low.shape[1] == len(v):
            assert (low <= exact).all() and (exact <= high).all()
        edge = negatives._largest(np.where(alive, low, -np.inf), 5)
        left.append(alive.shape[1])
        return alive & (high >= edge[:, None])

    places, score, alive = negatives.sliced(a, v, np.ones((3, 5000), bool), qualify)
    assert (score == (a @ v.T)[:, places]).all()
    for i, row in enumerate(a @ v.T):
        assert set(np.argsort(-row)[:5]) <= set(places[alive[i]])
    assert left[-1] < 1000  # before the last plane


def test_languages_are_learned(spark):
    got = language.op13_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_languages_of_odd_rows(spark, tmp_path):
    own = "doc_id long, text string, lang string, lang_pred string, Score int"
    rows = [(i, "the cat and the dog " * (1 + i % 3), "en", None, 1) for i in range(40)] + [(100 + i, "der hund und die katze", "de", None, 1) for i in range(40)]
    odd = [(None, "the cat", "en", "q", 1), (1000, None, "de", "q", 1), (1001, "", "de", "q", 1), (1002, "12 ! ?", "de", "q", 1), (1003, "UND " * 100_000 + "die", None, "q", 1), (1003, "und", None, "q", 1), (1004, "😀 the", "", None, 1)]
    df = spark.createDataFrame(rows + [r for r in odd if r[0] != 1004], own)
    model = language.learn(df.where(language.fold("doc_id", 5) != 0))
    assert model.languages == ["de", "en"]
    out = language.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "Score", "_lang_pred", "_score"] and out.count() == df.count()
    got = {(r["doc_id"], r["text"] and r["text"][:3]): (r["_lang_pred"], r["_score"]) for r in out.collect()}
    assert got[1000, None] == got[1001, ""] == got[1002, "12 "] == ("und", 0.0)
    assert got[1003, "UND"][0] == got[1003, "und"][0] == "de" and got[None, "the"][0] == "en"
    none = language.identify(df, language.learn(df.limit(0)))
    assert {tuple(r) for r in none.select("_lang_pred", "_score").distinct().collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), model).count() == 0


def test_pieces_have_the_same_ngrams():
    text = "Où est-il? ça va 12 bien " * 50
    whole = np.sort(np.concatenate([b for b, _ in language.batches_of([text])]))
    cut = np.sort(np.concatenate([b for b, _ in language.batches_of([text], 100)]))
    assert (whole == cut).all()
    pair = list(language.batches_of(["ab", None, "", "9", "ab"]))
    assert len(pair) == 1 and sorted(set(pair[0][1])) == [0, 4]
    assert sorted(pair[0][0][pair[0][1] == 0]) == sorted(pair[0][0][pair[0][1] == 4])
