"""The training-text operators against brute force on small corpora, and on odd input."""

import collections
import gc
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from homestead.llm import decontam, exact_dedup, html_text, jaccard, lattice, packing, quality, shingles, substring, suffix, templates

WORDS = [f"w{i}" for i in range(400)]
CLASH = {c: "x" for c in ("digest", "score", "uid", "id", "keep", "words", "sig", "component", "gone", "spans", "kept", "value")}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=3, n=60):
    """Texts with exact copies, near copies, shared passages and lines, repeats inside a text, empty and long ones."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "User 17 of host a9 logged in at 12:30"
    texts = []
    for i in range(n):
        t = "\n".join(prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 5)))
        if i % 6 == 1:
            t = texts[-1]
        if i % 6 == 2:
            words = texts[-1].split(" ")
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        if i % 7 == 3:
            t += f"\n{passage}\n" + prose(rng, 9)
        if i % 5 == 0:
            t += "\n" + line.replace("17", str(i))
        texts.append(t)
    return [*texts, "", None, " \t\n ", "one two", passage + " " + passage, prose(rng, 20_000), "é" * 500 + " ß", "x" * 300_000]


def frame(spark, texts, ids=None, clash=True):
    ids = list(range(len(texts))) if ids is None else ids
    names = list(CLASH) if clash else []
    return spark.createDataFrame([(i, t, *(CLASH[c] for c in names)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string" + "".join(f", {c} string" for c in names)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest string")


def test_exact_dedup_groups_equal_texts(spark):
    texts = corpus()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    rows = exact_dedup.decide(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r.id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.id == max(own))
        assert r.digest == hashlib.sha256((texts[r.id] or "").encode()).digest()


def test_exact_dedup_compares_bytes_under_one_digest(spark):
    from pyspark.sql import functions as F

    texts = ["aa", "bb", "aa", "ccc", "bb"]
    rows = exact_dedup.decide(frame(spark, texts), digest=lambda c: F.encode(F.length(c).cast("string"), "utf-8")).collect()
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in rows} == {(0, 2, 2, False), (2, 2, 2, True), (1, 4, 2, False), (4, 4, 2, True), (3, 3, 1, True)}


def test_exact_dedup_state_meets_later_arrivals(spark):
    d = exact_dedup.ExactDeduplicator(spark)
    assert {(r.id, r.kept) for r in d.add(frame(spark, ["a", "b"], [1, 2])).collect()} == {(1, True), (2, True)}
    assert {(r.id, r.keep_id, r.kept) for r in d.add(frame(spark, ["a", "c"], [5, 6])).collect()} == {(5, 5, True), (6, 6, True)}
    assert {(r.id, r.keep_id, r.kept) for r in d.add(frame(spark, ["a"], [3])).collect()} == {(3, 5, False)}


def test_exact_dedup_takes_up_its_state_and_compares_bytes_across_arrivals(spark):
    from pyspark.sql import functions as F

    first = exact_dedup.ExactDeduplicator(spark, digest=lambda c: F.encode(F.length(c).cast("string"), "utf-8"))
    first.add(frame(spark, ["aa", "ccc"], [1, 9]))
    again = exact_dedup.ExactDeduplicator(spark, home=first.home, digest=first.digest)
    rows = again.add(frame(spark, ["bb", "ccc", "dddd"], [2, 3, 4]))
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in rows.collect()} == {(2, 2, 1, True), (3, 9, 2, False), (4, 4, 1, True)}
    same = again.add(frame(spark, ["bb", "ccc", "dddd"], [2, 3, 4]), run=1)
    assert {(r.id, r.keep_id, r.group_size) for r in same.collect()} == {(2, 2, 1), (3, 9, 2), (4, 4, 1)} and again.runs() == [0, 1]


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = frame(spark, ["a", "a", "b", "b", None, "", "c"], [1, 1, 2, 3, None, 7, None])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", "a"), ("3", "b"), ("7", ""), ("None", "c")]
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    texts = [*corpus(), "odd\x1cspace and 'quotes' isn't <|endoftext|> 12345", "ÀÉ ﬁ İ é"]
    tok = Tokenizer.from_file(packing.default_tokenizer_file())
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(frame(spark, texts)).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(ids[i])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(frame(spark, ["a b", "a b", "c"], [None, None, 4])).count() >= 3


def test_packing_asks_the_tokenizer_for_pieces_of_words_once(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer_file()
    tok, ids = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(9)
    bits = ["'s", "'S", "'Re", "''", "<|endoftext|>", "<|end", "\x1f", "\x85", "\u00a0", "e\u0301", "\u0130", "\u03a3", "\ufb01", "\u00bd", "\u4e00", "_#", "12", "\u00df", "\u00c9t\u00e9", "\u0401\u0436", "\u2019", "\u00ab", "\U0001f600", *"abCD.,'! \n\x00"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert ids(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    asked = []
    fresh = packing.Encoder(path)
    for name in ("whole", "piece"):
        monkeypatch.setattr(fresh, name, lambda text, of=getattr(fresh, name): asked.append(text) or of(text))
    fresh.pieces.ids = fresh.piece
    fresh("Qorvane qorvane, (QORVANE) qorvane's 'Qorvane' \u00dcbrax \u00fcbrax! qorvane.")
    assert sorted(asked) == sorted({"qorvane", ",", "(", ")", "'s", "'", "\u00fcbrax", "!", "."})


def test_packing_workers_forget_words_when_they_are_idle(spark):
    packing.pack(frame(spark, [f"word{i} again" for i in range(50)])).collect()
    time.sleep(packing.IDLE_S + 2)

    def held(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [sum(isinstance(x, packing.Encoder) for x in gc.get_objects())] * len(batch)})

    assert {r["n"] for r in spark.range(0, 64, 1, 8).mapInPandas(held, "n int").collect()} == {0}


def test_packing_remembers_a_word_of_one_piece_once(monkeypatch):
    monkeypatch.setattr(packing, "WORD_BYTES", 20_000)
    path = packing.default_tokenizer_file()
    own, text = packing.Encoder(path), "plain wörter, plain! слово ещё, "
    assert own(text * 8) == own.whole(text * 8)
    assert "plain" in own.words and not {"слово"} & own.pieces.keys() and "," in own.pieces
    rare = " ".join(f"q{i}x" for i in range(500))
    for _ in range(5):
        assert own(rare) == own.whole(rare)
    assert 10 < len(own.words) < 110


def test_packing_deals_long_texts_to_groups_of_like_size_and_cost(spark):
    rng = random.Random(4)
    texts = [prose(rng, 40_000) for _ in range(6)] + [prose(rng, rng.randint(20, 900)) for _ in range(60)]
    windows, groups = collections.Counter(), collections.defaultdict(set)
    for r in packing.pack(frame(spark, texts).coalesce(1)).collect():
        windows[r.sequence_id] += r.length**2
        groups[r.step_group].add(r.sequence_id)
    assert sum(map(len, groups.values())) == len(windows) > 6 * packing.STEP_WINDOWS
    sizes, costs = [len(g) for g in groups.values()], [sum(windows[s] for s in g) for g in groups.values()]
    assert max(sizes) <= packing.STEP_WINDOWS and max(sizes) - min(sizes) <= 1
    assert max(costs) - min(costs) <= 2 * max(windows.values())


def test_decontamination_finds_substituted_passages_only(spark):
    rng = random.Random(5)
    items = [prose(rng, 40), prose(rng, 25), "just seven words are in this item", "too short", None, ""]
    swapped = items[0].split()
    swapped[5] = swapped[17] = swapped[30] = "other"
    texts = [prose(rng, 50) + " " + items[0].upper() + " " + prose(rng, 9), prose(rng, 5) + " " + " ".join(swapped), prose(rng, 30), "so just, seven words are in THIS item.", items[1], None, "", "too short", items[1] * 2, " ".join(items[0].split()[:12])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.id, r.item) for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    assert found == {(0, 0), (1, 0), (3, 2), (4, 1), (7, 3), (8, 1)}
    assert (7, 3) not in {(r.id, r.item) for r in decontam.contaminated(frame(spark, texts), bench, min_tokens=5).collect()}
    left = decontam.drop_contaminated(frame(spark, texts, [0, None, None, None, 4, 5, 6, 7, 8, 9]), bench)
    assert {(r.doc_id, r.text) for r in left.collect()} == {(None, texts[2]), (5, None), (6, ""), (9, texts[9])}
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_masks_leave_out_no_pattern():
    for width in range(1, decontam.WINDOW + 1):
        spots = [{at + k for k, c in enumerate(m) if c == "1"} for m in decontam.masks_of(width) for at in range(width - len(m) + 1)]
        for lost in itertools.combinations(range(width), width - math.ceil(decontam.SHARE * width)):
            assert any(spot.isdisjoint(lost) for spot in spots), (width, lost)


def test_decontamination_finds_any_tolerated_substitutions(spark):
    rng = random.Random(6)
    items = [" ".join(f"i{n}x{k}" for k in range(n)) for n in (5, 7, 9, 10, 12, 14, 15, 16, 18, 20, 24)]
    texts, expected = [], set()
    for i, item in enumerate(items):
        width = min(len(item.split()), decontam.WINDOW)
        allowed = width - math.ceil(decontam.SHARE * width)
        patterns = list(itertools.combinations(range(width), allowed))
        for lost in rng.sample(patterns, min(30, len(patterns))) + [tuple(range(allowed + 1))]:
            words = item.split()[:width]
            for k in lost:
                words[k] = "other"
            if len(lost) == allowed:
                expected.add((len(texts), i))
            texts.append(prose(rng, 6) + " " + " ".join(words) + " " + prose(rng, 6))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.id, r.item) for r in decontam.contaminated(frame(spark, texts), bench).collect()} == expected


def test_decontamination_equals_a_plain_search_with_repeats_ties_and_long_texts(spark):
    rng = random.Random(9)
    items = [prose(rng, 30), prose(rng, 16), "w1 w2", "w7"]
    texts = [f"«{items[0]}» then {items[0]}", items[1], items[1], prose(rng, 30_000) + " " + items[1], prose(rng, 12), "?", "W1, w2!", items[0].rsplit(" ", 12)[0]]
    ids = [1, 2, 2, 3, 4, 5, 6, 7]
    split = lambda t: re.findall(r"[^\W_]+", t.lower())

    def best(text, item):
        doc, words = split(text), split(item)
        width = min(len(words), decontam.WINDOW)
        found = []
        for shift in range(-len(words), len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(words)]
            found += [(sum(same[k : k + width]), -(k + shift), k) for k in range(len(words) - width + 1)]
        top = max(found, default=(0, 0, 0))
        return (top[0], -top[1]) if top[0] >= decontam.SHARE * width else None

    expected = {(i, k): best(t, item) for i, t in zip(ids, texts, strict=True) for k, item in enumerate(items) if best(t, item)}
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.contaminated(frame(spark, texts, ids), bench).collect()
    assert len(rows) == len(expected) and {(r.id, r.item): (r.equal, r.start) for r in rows} == expected


def test_html_of_repeated_rows_and_long_pages(spark):
    long = PAGE.replace("First", "First " + "and more text. " * 20_000)
    pages = spark.createDataFrame([(1, PAGE), (1, PAGE), (None, long)], "page_id long, html string")
    got = html_text.extract(pages, html_text.train([PAGE] * 20), name="t").collect()
    assert got[0].t == got[1].t != "" and len(got[2].t) > 280_000


def test_quality_learns_held_out_labels(spark):
    rng = random.Random(1)
    texts = [prose(rng, 40) if i % 2 else " ".join(f"{w}###" for w in prose(rng, 40).split()) for i in range(400)]
    docs = frame(spark, [*texts, None, "", "x" * 300_000])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model, name="p").select("doc_id", "p").collect()
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(r.p >= 0.5) == r.doc_id % 2 for r in held]) > 0.95
    assert all(0 <= r.p <= 1 for r in rows)
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id < 400 AND doc_id % 2 = 1").count() == 200
    assert quality.score(empty(spark), quality.learn(empty(spark), labels)).count() == 0


def test_features_stay_inside_words_and_ignore_case():
    assert len(quality.features(b"")) == 0 and len(quality.features(b"  \n")) == 0
    assert sorted(quality.features(b"ab cd")) == sorted(quality.features(b"CD\tAB"))
    assert quality.features(b"ab")[0] == quality.features(b"zz ab")[1]


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/x">All of it</a></li></ul></nav><article><h1>The &amp; title</h1><p>First  of\n the paragraphs, with some text.<p>Second &eacute; one.</article><footer>&copy; someone</footer></body></html>'


def test_html_keeps_the_article(spark):
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate([PAGE, None, "", "no markup at all", "<p>", "<div" * 50, "<!-- only", PAGE.replace("<article>", '<div class="post-body">').replace("</article>", '</div><div id="comments"><p>I agree with you.</p></div>')])], "page_id long, url string, html string, main string")
    model = html_text.train([PAGE] * 20)
    got = {r.page_id: r.t for r in html_text.extract(pages, model, name="t").collect()}
    assert got[0] == "The & title\nFirst of the paragraphs, with some text.\nSecond é one."
    assert got[1] == got[2] == got[4] == got[6] == ""
    assert got[7] == got[0]
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0)), name="t").count() == 0


def test_html_keeps_text_of_pages_without_names_or_closed_tags():
    model = html_text.train(pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:100])
    read = lambda source: (lambda p: p.text(html_text.decode(p, model[1].log_odds(html_text.node_features(p, model[0])))))(html_text.Page(source))
    text = "A paragraph of some length, with a first sentence in it. It has a second one, which is as long as the first."
    assert read(f"<div><div><a href=x>Home</a></div><div><a href=y>About us</a></div></div><div><div>{text}</div><div>{text} {text}</div></div>").count("paragraph") == 3
    began = time.perf_counter()
    page = html_text.Page("<b>x" * 60_000 + "<div>" * 20_000 + "<li>y<i>" * 20_000 + "</b>")
    assert time.perf_counter() - began < 10 and sum(len(t) for _, t in page.blocks) >= 80_000


def test_html_page_equals_a_plain_reading(spark):
    page = html_text.Page("<p>a <b>b</b>&amp;c<p>d<ul><li>e<li>f<script>x</script></ul><table><tr><td>g<td>h</table>i")
    assert [t for _, t in page.blocks] == ["a b&c", "d", "e", "f", "g", "h", "i"]
    assert [page.tag[n] for n, _ in page.blocks] == ["p", "p", "li", "li", "td", "td", "#root"]


def test_html_decoding_drops_what_lies_in_dropped_elements():
    page = html_text.Page("<div><p>a</p><p>b</p></div><p>c</p>")
    odds = np.array([0.0, 9.0, -1.0, -1.0, -3.0])
    assert html_text.decode(page, odds).tolist() == [True, False, False, False, True]
    assert html_text.decode(page, np.array([0.0, 1.0, -5.0, 2.0, -3.0])).tolist() == [True, True, True, False, True]


def test_lines_repeat_with_offsets(spark):
    texts = ["A first line of five words\nshort\nunique line number one is here", "a  FIRST line of five words\nshort", None, "", "other line of just five words\nother line of just five words"]
    rows = substring.repeated_units(frame(spark, texts)).collect()
    assert {(r.id, r.start, r.length, r.keep_id, r.n_copies) for r in rows if not r.kept} == {(1, 0, 27, 0, 2), (1, 28, 5, 0, 2), (4, 30, 29, 4, 2)}
    assert {(r.id, r.start) for r in rows if r.kept} == {(0, 0), (0, 27), (4, 0)}
    assert {r.start for r in substring.repeated_units(frame(spark, texts), min_words=6).collect()} == {0, 30}
    left = substring.remove_units(frame(spark, texts))
    assert left.columns == frame(spark, texts).columns
    assert {r.doc_id: r.text for r in left.collect()} == {0: texts[0], 1: "\n", 2: None, 3: "", 4: "other line of just five words\n"}
    assert substring.repeated_units(empty(spark)).count() == 0
    paragraphs = ["one two three four five\nsix\n\nnext part of the text here", "zero\n\none two three four five\nsix"]
    assert {(r.id, r.start) for r in substring.repeated_units(frame(spark, paragraphs), "paragraph").where("NOT kept").collect()} == {(1, 6)}


def test_passages_inside_lines_repeat(spark):
    rng = random.Random(21)
    sentence = lambda n: prose(rng, n).capitalize() + rng.choice(".!?")
    passage = " ".join(sentence(9) for _ in range(6))
    texts = [f"{sentence(8)} {passage} {sentence(7)}\n{sentence(9)}" for _ in range(4)] + [f"{sentence(8)} The the. {sentence(20)}" for _ in range(5)]
    rows = substring.repeated_units(frame(spark, texts), "sentence", min_passage=substring.PASSAGE_WORDS).collect()
    assert {r.id for r in rows} == {0, 1, 2, 3} and {r.id for r in rows if r.kept} == {0}
    assert all("".join(texts[i][r.start : r.start + r.length] for r in sorted(rows, key=lambda r: r.start) if r.id == i).strip() == passage for i in range(4))
    left = {r.doc_id: r.text for r in substring.remove_units(frame(spark, texts), "sentence", min_passage=substring.PASSAGE_WORDS).collect()}
    assert passage in left[0] and left[5] == texts[5] and all(passage[:300] not in left[i] and left[i].count(" ") >= 22 for i in (1, 2, 3))


def test_units_of_repeated_rows_and_null_ids_are_cut_by_row(spark):
    texts = ["one two three\na unique line", "a first of its kind\none two three", "one two three", "one two three", "x y " * 30_000 + "\n" + "x y " * 30_000]
    left = substring.remove_units(frame(spark, texts, [7, 7, None, None, 3])).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("None", "one two three"), ("None", ""), ("7", "\na unique line"), ("7", "a first of its kind\n"), ("3", "x y " * 30_000 + "\n")])


def covered(texts, n=400):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        mark = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n] -= 1
        out.append(np.cumsum(mark[:-1]) > 0)
    return raw, out


@pytest.mark.parametrize("bucket", [20_000, 1])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET", bucket)
    rng = random.Random(8)
    base = prose(rng, 400)
    texts = [t for t in corpus(9, 30) if t is None or len(t) < 50_000] + [base, base[100:900], prose(rng, 30) + base[300:820] + prose(rng, 30), base[300:720], "ab" * 500, "ab" * 300, "z" * 401, "z" * 400, base[:399], prose(rng, 5) + base[300:705]]
    raw, marks = covered(texts)
    rows = suffix.remove_repeats(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        m = marks[r.id]
        assert bytes(r.kept) == bytes(np.frombuffer(raw[r.id], np.uint8)[~m])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(m), m.sum(), (np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())


def test_suffix_anchors_tell_of_shorter_repeats(spark):
    rng = random.Random(31)
    passages = [" ".join(f"p{i}x{k}" for k in range(60))[:290] for i in range(8)]
    own = lambda: " ".join(f"o{rng.random():.9f}" for _ in range(60))
    texts = [f"{own()} {p} {own()}" for p in passages for _ in range(2)] + [own() + own() for _ in range(8)]
    got = {r.id: (r.n_removed, r.n_short_repeats > 0) for r in suffix.remove_repeats(frame(spark, texts)).collect()}
    assert got == {i: (0, i < 16) for i in range(24)}


def test_suffix_dedup_of_repeated_rows_and_empty_tables(spark):
    text = prose(random.Random(2), 200)
    rows = suffix.remove_repeats(frame(spark, [text, text, "short"], [None, None, 1])).collect()
    assert sorted(r.n_removed for r in rows) == [0, len(text), len(text)]
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_multikey_sort_orders_rows():
    words = np.random.default_rng(1).integers(0, 3, (300, 5)).astype(np.uint64)
    order = suffix.multikey_sort(words)
    assert [tuple(r) for r in words[order]] == sorted(tuple(r) for r in words)


def test_lattice_sums_over_all_segmentations():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"ba"] + [bytes([i]) for i in range(256) if bytes([i]) not in (b" ", b"a", b"b")]
    logp = np.log(np.random.default_rng(3).dirichlet(np.ones(len(pieces))))
    p = dict(zip(pieces, np.exp(logp), strict=True))

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    trie, words = lattice.Lattice(pieces), [b"abab", b"a", "é".encode(), b"bbbbbbbb", b"zzab"]
    counts = np.array([1.0, 2, 3, 4, 5])
    got, used = np.empty(len(words)), 0
    for part, cells, lengths in lattice.tabled(words):
        got[part] = trie.score(cells, lengths, logp)
        used = used + trie.expected(cells, lengths, logp, counts[part])
    assert np.allclose(got, [np.log(total(b" " + w)) for w in words])
    assert np.isclose(sum(len(pieces[i]) * n for i, n in enumerate(used)), sum(c * (len(w) + 1) for c, w in zip(counts, words, strict=True)))


def test_lm_scores_and_base(spark):
    texts = corpus(4, 40)
    rows = lattice.score(frame(spark, texts), em_steps=1).collect()
    split = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in train for w in split(texts[i]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    assert len(rows) == len(texts)
    for r in rows:
        words = split(texts[r.id])
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words) + np.log10((len(train) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words) + 1, sum(counts[w] > 0 for w in words) + 1, n, r.id not in train)
        assert np.isclose(r.base_score, base) and np.isfinite(r.score) and r.score < 0
    assert lattice.score(empty(spark)).count() == 0


def test_lm_fitting_beats_the_scores_it_starts_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    start, fitted = (lattice.score(docs, em_steps=n).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s").first().s for n in (0, 2))
    assert fitted > start + 0.1


def test_lm_score_of_a_text_is_the_sum_over_its_words(spark):
    texts = ["ab ab\nzz", "ab", "ab ab\nzz ab", ""]
    got = {r.id: r.score for r in lattice.score(frame(spark, texts, [1, 3, 5, 6]), em_steps=0).collect()}
    end = got[6]
    assert got[5] - end == pytest.approx((got[1] - end) + (got[3] - end))


def test_quality_features_and_a_step_of_descent_equal_plain_loops():
    raw = b"one two one"
    keys, counts = quality.bag(raw)
    every = collections.Counter(quality.features(raw).tolist())
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == dict(every)
    model = quality.train([raw, b"three"], np.array([1, 0]), epochs=30, rate=0.5)
    assert model.log_odds(raw) == pytest.approx(sum(model.margin[k] * n for k, n in every.items()) / sum(every.values()) + model.bias, abs=1e-5)
    assert model.log_odds(raw) > 0 > model.log_odds(b"three")


def test_templates_generalise_fields(spark):
    texts = [f"user {i} logged in from host h{i}\nsome other line with words {chr(97 + i) * 3}" for i in range(4)] + ["user x logged in from host\nno", None, ""]
    rows = templates.template_lines(frame(spark, texts)).collect()
    assert {(r.id, r.line_no) for r in rows} == {(i, n) for i in range(4) for n in (0, 1)}
    assert {r.template for r in rows} == {"user <*> logged in from host <*>", "some other line with words <*>"}
    left = {r.doc_id: r.text for r in templates.drop_template_lines(frame(spark, texts)).collect()}
    assert left[0] == "" and left[4] == texts[4] and left[5] is None
    assert templates.template_lines(empty(spark)).count() == 0
    odd = ["a b c", "a b c", "a b c", "a b c", None, "", "w " * 20_000 + "\na b c"]
    assert sorted((str(r.id), r.n_docs) for r in templates.template_lines(frame(spark, odd, [1, 2, None, 2, None, 3, 4])).collect()) == sorted([("1", 4), ("2", 4), ("2", 4), ("None", 4), ("4", 4)])
    assert {r.text for r in templates.drop_template_lines(frame(spark, odd, [1, 2, None, 2, None, 3, 4])).where("doc_id IS NOT NULL").collect()} == {"", "w " * 20_000}


def shingled(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(11)
    base, texts = prose(rng, 150).split(), corpus(6, 40)
    for _ in range(60):  # a family of near copies with various numbers of changes
        w = base[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    texts += [" ".join(base[:100]) + " " + prose(rng, rng.randint(5, 60)) for _ in range(30)] + ["a b c d e f", "a b c d e f g", "a b", "A  b"]
    sets = [shingled(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in rows) == [(i, len(s), find(i)) for i, s in enumerate(sets)]
    left = jaccard.drop_near_copies(frame(spark, texts))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in range(len(texts)) if find(i) == i)


def test_jaccard_links_classes_whose_buckets_start_with_other_sizes(spark):
    rng = random.Random(12)
    y = prose(rng, 14)
    texts = [y, y + " " + prose(rng, 1)] + [f"{y} " + " ".join(f"e{i}x{k}" for k in range(4)) for i in range(300)]
    sets = [shingled(t) for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1])
    assert all(100 * len(sets[k] & s) < 80 * len(sets[k] | s) for k in (0, 1) for s in sets[2:])
    rows = jaccard.groups(frame(spark, texts)).collect()
    assert sorted((r.id, r.component_id) for r in rows) == [(i, max(0, i - (i == 1))) for i in range(len(texts))]


def test_jaccard_of_odd_input(spark):
    rows = jaccard.groups(frame(spark, ["a b c d e f", "a b c d e f", None, "", "x y"], [None, 4, 5, None, 9])).collect()
    assert sorted((str(r.id), r.n_shingles, r.component_id) for r in rows) == [("4", 2, 4), ("5", 0, 5), ("9", 1, 9), ("None", 0, None), ("None", 2, 4)]
    assert jaccard.groups(empty(spark)).count() == 0


def test_jaccard_drops_rows_without_id_by_their_groups(spark):
    near = prose(random.Random(3), 60)
    texts = [near, near + " end", "an unrelated text of some words", "a b c d e f", "a b c d e f", "lone words here"]
    left = jaccard.drop_near_copies(frame(spark, texts, [None, 7, None, None, None, 2]))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("2", texts[5]), ("7", texts[1]), ("None", texts[3]), ("None", texts[3]), ("None", texts[2])]


def test_jaccard_subsets_that_sets_need_are_shared():
    rng = np.random.default_rng(7)
    for n in [*range(1, 40), 90, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            keep = a[rng.permutation(n)[: n - int(rng.integers(0, n // 5 + 1))]]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common):
                met = [(need, len(np.intersect1d(x, y))) for _, need, x in jaccard.signatures(a) for _, _, y in jaccard.signatures(b)]
                assert any(shared >= need for need, shared in met)
                met = [(need, len(np.intersect1d(x, y))) for _, need, x in jaccard.signatures(b) for _, _, y in jaccard.signatures(a)]
                assert any(shared >= need for need, shared in met)


def test_word_hashes_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    rng = random.Random(2)
    raw = prose(rng, 500).encode() + b" " + b"q" * 700 + b" end"
    whole = shingles.word_hashes(raw)
    monkeypatch.setattr(shingles, "_AT_ONCE", 200)
    cut = shingles.word_hashes(raw)
    assert len(cut) == len(whole) and (cut[:500] == whole[:500]).all() and cut[-1] == whole[-1]


def test_html_tags_with_odd_quotes():
    """Quotes open a value only after "=" and close it only at its end; comments go wherever they are told by place and form."""
    model = html_text.train(pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:100])
    read = lambda source: (lambda p: p.text(html_text.decode(p, model[1].log_odds(html_text.node_features(p, model[0])))))(html_text.Page(source))
    paragraphs = ["The farmer's field was wide, and it didn't end at the river.", "He said that it wouldn't rain before the evening came.", "So they went on, and the work was done by noon, as it had to be."]
    body, whole = "".join(f"<p>{p}</p>" for p in paragraphs), "\n".join(paragraphs)
    for opening in ("<article data-author=O'Brien>", "<article><img alt='the boy's hat'>", '<article data-x="<b>q</b>" title=\'a > b\'>', "<article class = x data-y='' z>"):
        assert read(f"<html><body>{opening}{body}</article></body></html>") == whole
    assert read("<div class=o'neil><p>First text.</p></div><p>It's here, don't go.</p>") == "First text.\nIt's here, don't go."
    assert read(f'<body><article><p class="foo>{paragraphs[0]}</p><p class="bar">{paragraphs[1]}</p></article></body>') == "\n".join(paragraphs[:2])
    replies = "".join(f"<div><p>{x}</p></div>" for x in ("I think this is wrong, sorry.", "Nice text, thanks for it!", "Who wrote that? Not me."))
    for form in ('<div id="disqus_thread">{}</div>', '<section class="replies">{}</section>', '<div class="user-feedback">{}</div>'):
        assert read(f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Of fields</h1>{body}</article>{form.format(replies)}<footer>c 2020</footer></body></html>") == f"Of fields\n{whole}"


def test_html_learns_from_a_bounded_number_of_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(i % 40, PAGE.replace("t</title>", f"{i}</title>"), "kept") for i in range(400)] + [(None, PAGE, "kept")], "page_id long, html string, main_text string")
    seen = []
    monkeypatch.setattr(html_text, "train", lambda sources: seen.append(len(sources)) or ({}, seen))
    assert html_text.learn(pages, rows=7)[1] == [7] and html_text.learn(pages.limit(0), rows=7)[1] is seen
    monkeypatch.undo()
    got = html_text.extract(pages, html_text.train([PAGE] * 20))
    assert got.columns == ["page_id", "html", "main_text", "_main_text"] and got.where("main_text = 'kept'").count() == 401


def test_quality_characters_and_bounds(spark):
    """N-grams are of characters; what is learned from is bounded though ids repeat; a caller's score stays."""
    two = set(quality.features("é".encode()).tolist())
    assert len(two) == 3 and not two & set(quality.features("è".encode()).tolist()) - set(quality.features(b"").tolist())
    assert len(quality.features("дом".encode())) == len(quality.features(b"dom"))
    long = ("ж" * quality.CHUNK).encode()
    assert b"".join(quality.pieces(long)) == long and all(p.decode() for p in quality.pieces(long))
    docs = spark.createDataFrame([(i % 30, f"good text {i}" if i % 30 < 15 else f"bad stuff {i}", "mine") for i in range(900)], "doc_id long, text string, Score string")
    labels = spark.createDataFrame([(i, int(i < 15), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, rows=2)
    assert model.rows == 2
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "Score", "_score"] and out.where("Score = 'mine'").count() == 900


def test_lattice_with_pieces_of_whole_words(monkeypatch):
    """What pieces and whole words explain sums to the counts; the way back over blocks gives the same as in one go."""
    pieces = [b" a", b"ab", b" ab", b"ba", b"abab"] + [bytes([i]) for i in range(256)]
    logp = np.log(np.random.default_rng(5).dirichlet(np.ones(len(pieces))))
    words, counts, whole = [b"abab" * 40, b"a", b"bababab"], np.array([2.0, 3, 4]), np.log(np.array([1e-9, 0.2, 1e-30]))
    out = []
    for edges in (1 << 18, 7):
        monkeypatch.setattr(lattice, "EDGES", edges)
        used, own = 0, 0.0
        for part, cells, lengths in lattice.tabled(words):
            times, more = lattice.Lattice(pieces).uses(cells, lengths, logp, counts[part], whole[part])
            used, own = used + times, own + more
        out.append((used, own))
    assert np.allclose(out[0][0], out[1][0]) and out[0][1] == pytest.approx(out[1][1])
    alone = [lattice.Lattice(pieces).score(c, n, logp)[0] for w in words for _, c, n in lattice.tabled([w])]
    assert own == pytest.approx(sum(c * np.exp(v) / (np.exp(v) + np.exp(s)) for c, v, s in zip(counts, whole, alone, strict=True)))


def test_lm_words_that_were_seen_are_likelier(spark):
    """A word of the training texts is one piece; new words still have a probability."""
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    held = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = frame(spark, ["zqxjzq kvwzzq"] * 60 + ["zqxjzq", "qzjxqz"], [*train, held, held])
    got = sorted(r.score for r in lattice.score(docs).where(f"id = {held}").collect())
    assert got[1] - got[0] > 3 and np.isfinite(got[0])
