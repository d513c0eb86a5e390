"""The pipeline on the smallest tables."""

import random

import corpus_pipeline
from homestead.llm.common import written

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        rows = {r.doc_id for r in after.select("doc_id").collect()}
        assert rows <= {r.doc_id for r in docs.select("doc_id").collect()} and len(rows) > n / 3
        docs = docs.where(docs.doc_id.isin(list(rows)))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == rows


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def made_corpus(spark, folder, rows, labels, items):
    """Tables with columns that clash with names the stages use."""
    spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, gone string, score string, digest string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_equal_plain_loops(spark, tmp_path):
    rng = random.Random(17)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(24)
    rows = []
    for i in range(60):
        text = prose(rng.randint(30, 90))
        if i % 9 == 1:
            text = rows[-1][1]
        if i % 9 == 2:
            text = rows[-1][1] + " end"
        if i % 10 == 5:
            text = f"{text} {item} {prose(5)}"
        rows.append((i, text))
    rows += [(100 + i, " ".join(f"{w}###" for w in prose(40).split())) for i in range(60)] + [(None, prose(40)), (500, None), (501, ""), (502, "q" * 200_000), (502, "another text of that id")]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, None), (7, None, None)]
    made_corpus(spark, tmp_path, rows, labels, [(1, item), (2, None), (None, "")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = sorted((str(r.doc_id), r.text) for r in docs.collect())
        assert len(docs.columns) == 8
    good = kept["quality"]
    assert {r for r in good if r[1] and "w" in r[1] and "#" not in r[1]} == {(str(i), t) for i, t in rows if t and "w" in t and "#" not in t} and not any("#" in (t or "") for _, t in good)
    best = {}
    for i, t in good:
        best[t or ""] = max(best.get(t or "", ("None", t)), (i, t), key=lambda r: -1 if r[0] == "None" else int(r[0]))
    assert kept["exact_dedup"] == sorted(best.values())
    shingled = {r: {tuple((r[1] or "").split()[k : k + 5]) for k in range(max(1, len((r[1] or "").split()) - 4))} - {()} for r in kept["exact_dedup"]}
    similar = lambda a, b: 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b]) > 0
    lower = lambda a, b: a[0] != "None" and b[0] != "None" and int(a[0]) < int(b[0])
    assert kept["near_dedup"] == sorted(r for r in kept["exact_dedup"] if not any(lower(o, r) and similar(o, r) for o in kept["exact_dedup"] if o != r))
    assert kept["decontamination"] == sorted(r for r in kept["near_dedup"] if item not in (r[1] or ""))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("start = 0").count() == len(kept["decontamination"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    made_corpus(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
