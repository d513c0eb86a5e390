"""Main text of web pages: boosted trees over DOM nodes, decoded over the tree.

Each block element gets features (text density of its subtree, share of linked text, learned weights of its tag and
attribute tokens and of those above it, depth, place among its siblings) and boosted trees give the log odds
that it belongs to the page's furniture. Keeping or dropping is then chosen for the whole tree at once, so that what
lies in a dropped element is dropped. The trees are trained in numpy, in one task, on a bounded sample of pages:
their articles, and the same articles set into layouts drawn at random, for which the right choice is known.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homestead.llm.common import first_by_hash, free_name, plain_text, released, short_batches, table

#: Pages that are learned from at most, taken by a hash of the id, and layouts with and without names made of each.
TRAIN_PAGES, LAYOUTS, PLAIN_LAYOUTS = 250, 3, 2
TREES, DEPTH, BINS, RATE = 60, 3, 24, 0.3
#: Of a learned article, blocks that a layout takes, blocks that serve as text of other parts, and characters of such text; pages that are read are never cut.
LAYOUT_BLOCKS, OTHER_BLOCKS, OTHER_CHARS = 30, 5, 500
#: A quote opens a value only after "=", and closes it only before white space, "/" or ">"; where it never does, the value ends as one without quotes.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s>]*+))?+)*+)>?|<[!?][^>]*>?", re.S)
ATTRIBUTES = re.compile(r"(?:^|\s)(?:class|id|role|aria-label|itemprop|data-[\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select button object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr input".split())
#: An opening tag that ends open elements of these kinds, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Page:
    """Block elements in page order (root first) and blocks of text."""

    def __init__(self, source: str):
        self.tag, self.up, self.tokens = ["#root"], [0], [()]
        self.children: list[list[int]] = [[]]
        self.linked, self.inline = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, parts, links, at, end = [(0, "#root")], [], 0, 0, len(source)
        # places in the stack of its block elements, and of the open elements of each tag, so that no step looks through the whole stack
        nesting, open_at = [0], defaultdict(list)

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.blocks.append((stack_node(), text))

        def stack_node() -> int:
            return stack[nesting[-1]][0]

        def push(node: int, tag: str) -> None:
            if node >= 0:
                nesting.append(len(stack))
            open_at[tag].append(len(stack))
            stack.append((node, tag))

        def close(to: int) -> None:
            nonlocal links
            if nesting[-1] >= to:
                flush()
            while len(stack) > to:
                node, tag = stack.pop()
                links -= tag == "a"
                open_at[tag].pop()
                if node >= 0:
                    nesting.pop()

        def say(text: str) -> None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                self.linked[stack_node()] += len(text)

        while at < end:
            m = TAG.search(source, at)
            if not m:
                say(source[at:])
                break
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                where = open_at[tag][-1] if open_at[tag] else 0
                if where and not (stack[where][0] < 0 and nesting[-1] > where):
                    close(where)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    over = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(source, at)
                    at = over.end() if over else end
                continue
            if tag in INLINE:
                self.inline[stack_node()] += 1
                if tag == "br":
                    parts.append(" ")
                elif tag not in VOID:
                    push(-1, tag)
                    links += tag == "a"
                continue
            flush()
            if tag in ENDS:
                own, stop = ENDS[tag]
                found = max((open_at[t][-1] for t in own if open_at[t]), default=0)
                if found > max((open_at[t][-1] for t in stop if open_at[t]), default=0):
                    close(found)
            elif stack[nesting[-1]][1] == "p":
                close(nesting[-1])
            if tag in VOID:
                continue
            node, parent = len(self.tag), stack_node()
            self.tag.append(tag)
            self.up.append(parent)
            self.tokens.append(tuple(t.lower() for a in ATTRIBUTES.findall(m[3]) for t in TOKENS.findall("".join(a))))
            self.children.append([])
            self.children[parent].append(node)
            self.linked.append(0)
            self.inline.append(0)
            if not m[3].endswith("/"):
                push(node, tag)
        flush()

    def text(self, keep: np.ndarray) -> str:
        return "\n".join(t for n, t in self.blocks if keep[n])


def node_features(page: Page, weights: dict[str, float]) -> np.ndarray:
    """A row of features for each block element."""
    n = len(page.tag)
    own, words, stops, linked, below, inline, blocks = ([0.0] * n for _ in range(7))
    for node, text in page.blocks:
        own[node] += len(text)
        words[node] += text.count(" ") + 1
        stops[node] += text.count(". ") + text.endswith((".", "!", "?"))
        blocks[node] += 1
    total, linked, inline = own[:], [float(x) for x in page.linked], [float(x) for x in page.inline]
    for k in range(n - 1, 0, -1):
        up = page.up[k]
        for values in (total, words, stops, linked, inline, blocks):
            values[up] += values[k]
        below[up] += below[k] + 1
    depth, attr, tag, low, rows = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n, []
    place, alike = [0] * n, [1] * n
    for kids in page.children:
        of_tag = Counter(page.tag[k] for k in kids)
        for i, k in enumerate(kids):
            place[k], alike[k] = i, of_tag[page.tag[k]]
    for k in range(n):
        up = page.up[k]
        depth[k] = depth[up] + 1 if k else 0
        known = [weights.get(t, 0.0) for t in page.tokens[k]]
        high, least = max(known, default=0.0), min(known, default=0.0)
        attr[k] = high if high > -least else least
        tag[k] = weights.get(f"<{page.tag[k]}", 0.0)
        # what the elements above say, the nearest last
        low[k] = (low[up] * 0.7 + (attr[up] + tag[up])) if k else 0.0
        kids = page.children[up]
        before, after = (total[kids[place[k] - 1]] if k and place[k] else 0.0), (total[kids[place[k] + 1]] if k and place[k] + 1 < len(kids) else 0.0)
        rows.append((tag[k], attr[k], high, least, low[k], depth[k], total[k], own[k], total[k] / (1 + below[k] + inline[k]), linked[k] / (1 + total[k]), stops[k] / (1 + words[k]), total[k] / (1 + total[0]), below[k], blocks[k], place[k] / max(1, len(kids)), len(kids), alike[k], before, after, attr[up], tag[up], len(page.tokens[k])))
    return np.array(rows)


class Trees:
    """Gradient boosting of the log odds with trees of fixed depth on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        self.edges = [np.unique(np.quantile(f, np.linspace(0, 1, BINS + 1)[1:-1])) for f in x.T]
        binned, share = self.bins(x), np.clip(y.mean(), 0.01, 0.99)
        self.start, self.trees, self.depth = float(np.log(share / (1 - share))), [], depth
        f = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), np.int64), []
            for level in range(depth):
                width = 1 << level
                best = [(1e-6, 0, BINS + 1)] * width
                for j in range(x.shape[1]):
                    key = leaf * (BINS + 1) + binned[:, j]
                    gs, hs = (np.bincount(key, v, width * (BINS + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    for node in range(width):
                        at = int(gain[node].argmax())
                        if gain[node, at] > best[node][0]:
                            best[node] = (float(gain[node, at]), j, at)
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                splits.append((feature, cut))
                leaf = leaf * 2 + (binned[np.arange(len(y)), feature[leaf]] > cut[leaf])
            value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
            self.trees.append((splits, value))
            f += value[leaf]
        return self

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, f, side="left") for e, f in zip(self.edges, x.T, strict=True)], 1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned, f, every = self.bins(x), np.full(len(x), self.start), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                leaf = leaf * 2 + (binned[every, feature[leaf]] > cut[leaf])
            f += value[leaf]
        return f


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The likeliest choice for the whole tree in which nothing below a dropped element is kept: True where kept."""
    n = len(odds)
    drop, keep = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    all_dropped, best = drop.copy(), keep.copy()
    for k in range(n - 1, -1, -1):
        for c in page.children[k]:
            all_dropped[k] += all_dropped[c]
            best[k] += max(best[c], all_dropped[c])
    kept = np.zeros(n, bool)
    for k in range(n):
        kept[k] = (k == 0 or kept[page.up[k]]) and (k == 0 or best[k] >= all_dropped[k])
    return kept


#: Layouts to learn from: names that authors give to a page's parts. {} takes text.
MAIN = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<section class="post-body">{}</section>', '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>', '<main><article class="post">{}</article></main>', '<div class="story-text">{}</div>', "<div>{}</div>")
LISTS = ("<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div class="breadcrumbs"><ul>{}</ul></div>', '<div id="navbar"><ul>{}</ul></div>', '<div class="related-links"><ul>{}</ul></div>', '<div class="pagination"><ul>{}</ul></div>', '<div class="tags"><ul>{}</ul></div>', '<aside class="widget"><h3>More</h3><ul>{}</ul></aside>', '<div class="share social"><ul>{}</ul></div>')
TOP = ("<header>{}</header>", '<div class="site-header">{}</div>', '<div id="masthead"><p>{}</p></div>', '<div class="topbar">{}</div>', '<header class="page-header"><div class="logo">{}</div></header>')
AROUND = ('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="sponsored promo">{}</div>', '<div class="banner ads">{}</div>', "<aside>{}</aside>", '<aside class="sidebar"><p>{}</p></aside>', '<div id="sidebar">{}</div>', '<div class="cookie-notice"><p>{}</p></div>', '<div id="cookie-banner" class="consent">{}</div>', '<div class="gdpr popup">{}</div>', '<div class="notice">{}</div>', '<div class="alert"><p>{}</p></div>', '<form action="/s"><p>{}</p><input name="q"></form>', '<form class="newsletter signup"><label>{}</label></form>', '<div class="newsletter subscribe"><p>{}</p></div>', '<div class="search"><form><p>{}</p></form></div>', '<div class="author-bio">{}</div>', '<div class="disclaimer"><p>{}</p></div>', '<div class="login modal"><p>{}</p></div>')
REPLIES = ('<div id="comments"><h3>Comments</h3>{}</div>', '<section class="comments">{}</section>', '<div class="comment-list">{}</div>', '<div class="discussion responses">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread">{}</div>', '<section class="replies"><h3>3 replies</h3>{}</section>', '<div class="user-feedback">{}</div>', '<div class="reader-reactions">{}</div>', '<div id="respond" class="reviews">{}</div>', '<ul class="talkback">{}</ul>', '<div class="conversation thread">{}</div>', "<section>{}</section>", "<div>{}</div>")
REPLY = ('<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="reply"><p>{}</p></li>', "<div><b>{}</b><p>{}</p></div>", '<div class="post-reply"><span class="user">{}</span><p>{}</p></div>', "<div><p>{}</p></div>")
BOTTOM = ("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="site-footer"><p>{}</p></div>', '<div class="copyright legal">{}</div>', '<footer class="bottom"><p>{}</p></footer>')
#: Layouts without any name: what a part is shows only in its text, links and place.
PLAIN_KINDS, PLAIN_LINKS = ("<div>{}</div>", "<div>{}</div>", "<p>{}</p>", "<div><span>{}</span></div>"), ("<div>{}</div>", "<div><div>{}</div></div>", "<ul>{}</ul>")
FALLBACK = ("Some words of a first paragraph, which says a little. It ends here.", "Another one.", "A third paragraph is somewhat longer than the others, and it has two sentences. This is the second.")


def plain_layout(blocks: list[str], others: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page of nested elements without names around the blocks, and marks of the blocks to keep: links before, the blocks, links and a short line after."""
    marks, keep = iter(range(10**9)), set()

    def marked(text: str, good: bool = False) -> str:
        m = f"\x01{next(marks)}\x02"
        if good:
            keep.add(m)
        return m + html.escape(text)

    pick = lambda options: options[int(rng.integers(len(options)))]
    short = lambda most: pick(others)[: int(rng.integers(8, most))]
    link = lambda form: form.format(f'<a href="/x">{marked(short(25))}</a>')
    links = lambda: pick(PLAIN_LINKS).format("".join(link(pick(("<div>{}</div>", "<li>{}</li>"))) for _ in range(int(rng.integers(2, 9)))))
    kind = pick(PLAIN_KINDS)
    blocks = blocks if rng.random() < 0.3 else blocks[int(rng.integers(0, len(blocks))) :][: int(rng.integers(1, 5))]
    main = f"<div>{''.join(kind.format(marked(t, True)) for t in blocks)}</div>"
    parts = [f"<div>{marked(short(40))}</div>" if rng.random() < 0.5 else "", links() if rng.random() < 0.8 else "", f"<div>{main}</div>" if rng.random() < 0.5 else main, links() if rng.random() < 0.5 else "", f"<div>{marked(short(70))}</div>" if rng.random() < 0.6 else ""]
    body = "".join(parts)
    return f"<html><body>{f'<div>{body}</div>' if rng.random() < 0.5 else body}</body></html>", keep


def layout(blocks: list[str], others: list[str], rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page around the blocks, and marks of the blocks to keep (each block of the page starts with its own mark)."""
    marks, keep = iter(range(10**9)), set()

    def marked(text: str, good: bool = False) -> str:
        m = f"\x01{next(marks)}\x02"
        if good:
            keep.add(m)
        return m + html.escape(text)

    pick = lambda options: options[int(rng.integers(len(options)))]
    other = lambda: pick(others)[: int(rng.integers(10, OTHER_CHARS))]
    items = lambda: "".join(f'<li><a href="/x">{marked(other()[:25])}</a></li>' for _ in range(int(rng.integers(2, 9))))
    around = lambda: pick(AROUND).format(marked(other()))
    wrap = lambda s, p: f'<div class="{pick(("wrapper", "container", "page", "row", "col", "inner"))}">{s}</div>' if rng.random() < p else s
    kinds = ("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}</b></p>", "<p>{}<br>", "<p>{}")
    inside = [pick(kinds).format(marked(t, True)) for t in blocks]
    inside[:1] = [f"<h1>{marked(blocks[0][:60], True)}</h1>", *inside[:1]]
    for _ in range(int(rng.integers(0, 3))):
        inside.insert(int(rng.integers(1, len(inside) + 1)), around() if rng.random() < 0.8 else pick(LISTS).format(items()))

    def replies() -> str:
        """Short texts after the article, all of one form, some with a line that says who."""
        form = pick(REPLY)
        return pick(REPLIES).format("".join(form.format(*([marked(other()[:12])] if form.count("{}") == 2 else []), marked(other()[: int(rng.integers(20, 160))])) for _ in range(int(rng.integers(1, 6)))))

    if rng.random() < 0.3:
        inside.append(replies())
    parts = [pick(TOP).format(marked(other()[:80])) if rng.random() < 0.6 else "", pick(LISTS).format(items()) if rng.random() < 0.8 else "", around() if rng.random() < 0.7 else ""]
    parts += [wrap(pick(MAIN).format("".join(inside)), 0.5), replies() if rng.random() < 0.4 else "", around() if rng.random() < 0.6 else "", pick(LISTS).format(items()) if rng.random() < 0.3 else "", pick(BOTTOM).format(marked(other()[:150])) if rng.random() < 0.8 else ""]
    return f"<html><head><title>t</title></head><body>{wrap(''.join(parts), 0.4)}</body></html>", keep


def labelled(page: Page, keep: set[str]) -> np.ndarray:
    """1 for elements that hold text, none of it marked to keep; -1 for elements without text, which aren't learned from."""
    good, some = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for k, (node, text) in enumerate(page.blocks):
        marks = set(re.findall("\x01\\d+\x02", text))
        some[node] += 1
        good[node] += bool(marks & keep)
        page.blocks[k] = node, re.sub("\x01\\d+\x02", "", text)
    for k in range(len(page.tag) - 1, 0, -1):
        some[page.up[k]] += some[k]
        good[page.up[k]] += good[k]
    return np.where(some == 0, -1, good == 0)


def train(sources: list[str], seed: int = 5, layouts: int = LAYOUTS) -> tuple[dict[str, float], Trees]:
    """Weights of tags and attribute tokens, and trees, from the articles of the pages and layouts made of them."""
    rng, articles, cases = np.random.default_rng(seed), [], []
    for source in sources:
        page = Page(source)
        inside = np.zeros(len(page.tag), bool)
        for k in range(1, len(page.tag)):
            inside[k] = inside[page.up[k]] or page.tag[k] in ("article", "main")
        blocks = [t for n, t in page.blocks if inside[n]]
        if blocks:
            articles.append(blocks)
            some, good = np.zeros(len(page.tag)), np.zeros(len(page.tag))
            for n, _ in page.blocks:
                some[n] += 1
                good[n] += inside[n]
            for k in range(len(page.tag) - 1, 0, -1):
                some[page.up[k]] += some[k]
                good[page.up[k]] += good[k]
            cases.append((page, np.where(some == 0, -1, good == 0)))
    articles = articles or [list(FALLBACK)]
    others = [t for a in articles for t in a[:OTHER_BLOCKS]] + list(FALLBACK)
    for blocks in articles:
        for make in (*[layout] * layouts, *[plain_layout] * PLAIN_LAYOUTS):
            source, keep = make(blocks[:LAYOUT_BLOCKS], others, rng)
            page = Page(source)
            cases.append((page, labelled(page, keep)))
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for page, drop in cases:
        for k, d in enumerate(drop.tolist()):
            if d >= 0:
                for t in {*page.tokens[k], f"<{page.tag[k]}"}:
                    seen[t][int(d)] += 1
    weights = {t: float(np.log((d + 1) / (k + 1))) for t, (k, d) in seen.items() if k + d >= 3}
    # tokens that a case teaches are now and then unknown, so that the other features are learned too
    known = lambda: {t: w for t, w in weights.items() if t[0] == "<" or rng.random() > 0.1}
    x, y = np.concatenate([node_features(p, known()) for p, _ in cases]), np.concatenate([d for _, d in cases])
    return weights, Trees().fit(x[y >= 0], y[y >= 0].astype(float))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAIN_PAGES) -> tuple[dict[str, float], Trees]:
    """Learns from at most `rows` pages, the same ones each time, in one task. They are chosen by their ids; of pages of one id the least counts, and pages without id are not learned from."""
    known = pages.select(F.col(id_col).alias("id"), plain_text(F.col(html_col)).alias("html")).where("id IS NOT NULL")
    chosen = first_by_hash(known.select("id").distinct(), "id", rows)
    sample = known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy(F.xxhash64("id"), "id")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [pickle.dumps(train([h for b in batches for h in b["html"].tolist()]))]})

    got = sample.select("html").coalesce(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(got["model"]) if got else train([])


def extract(pages: DataFrame, model: tuple[dict[str, float], Trees], html_col: str = "html", name: str = "main_text") -> DataFrame:
    """pages with the main text: the kept blocks in page order, one a line. A null or empty page has an empty text. Where pages has a column of that name, the new one has underscores before it."""
    name = free_name(pages, name)
    held = short_batches(pages).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, trees = held.value
        for sources in batches:
            out: list[str] = []
            for at in range(0, len(sources), 64):
                made = [Page(s) for s in sources.iloc[at : at + 64]]
                rows = [node_features(p, weights) for p in made]
                odds = np.split(trees.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                out += [p.text(decode(p, o)) for p, o in zip(made, odds, strict=True)]
            yield pd.Series(out, dtype="object")
        released()

    return pages.withColumn(name, main_text(plain_text(F.col(html_col))))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages. A null html is an empty page; repeated pages each have a row; of other columns than page_id, url and html nothing is read."""
    pages = table(spark, sf_dir, "pages")
    done = extract(pages.select("page_id", "url", "html"), learn(pages), name="main")
    return done.select("page_id", "url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
