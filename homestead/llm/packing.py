"""Hierarchical packing of documents into training sequences of several lengths.

Each task reads its part of the documents once and packs what it reads; nothing is shuffled, so no source,
group of copies or long document can gather anywhere, and a task that is run again gives the same pieces.
A document of n tokens first gives n // 2048 full windows, which wait to be dealt. What is left is routed to the smallest
context tier (256, 512, 1024 or 2048) that holds it and waits in that tier's queue. When the task's queues are full, the
tiers are packed from the longest to the shortest: each window opens with the longest piece of its tier and
its gap is filled with the longest waiting pieces that fit, from its own and all shorter tiers; a gap that
no piece fits is filled by cutting one. The windows of a pool, with the full ones that wait, are dealt to step groups so that groups get
like numbers of windows and like sums of squared piece lengths, the cost of attention; a group may hold windows of several lengths. The last window of a pool, which alone cannot be
filled, is cut into powers of two.
"""

from __future__ import annotations

import bisect
import gc
import json
import re
import struct
import threading
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from homestead.llm.common import plain_text, released, short_batches, table

TIERS = (256, 512, 1024, 2048)
#: Pieces that wait in a task before they are packed, and tokens in them and in full windows at most.
POOL_PIECES, POOL_TOKENS = 4096, 2_000_000
#: Windows that one step of training takes.
STEP_WINDOWS = 16
#: Bytes of words and of pieces of words, with their ids, that a worker remembers; what Python adds to each at most.
WORD_BYTES, PIECE_BYTES, MEMO_ENTRY = 64 << 20, 32 << 20, 190
#: How often a word and a piece must be met to be remembered; strings not yet remembered that are told apart; the latest of them, whose ids are at hand.
WORD_TIMES, PIECE_TIMES, MARKS, LATEST = 3, 2, 1 << 21, 20_000
#: Seconds after the last task of packing in which a worker, which lives on and serves other stages, still remembers them.
IDLE_S = 3.0
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, window int, step_group bigint"
#: White space for Python, but not for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: How a tokenizer is made whose words fall into pieces as PIECE says, when they are in lower case and of PLAIN letters only.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LETTERS = "a-zß-öø-ÿа-яё"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
PLAIN = "\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿА-яЁё«»‘’“”–—…€"
#: The letters that a tokenizer of bytes has for them.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


class Memo(dict):
    """The ids of strings; the first of those that are met so many times are remembered."""

    def __init__(self, ids: Callable[[str], bytes], room: int, times: int):
        super().__init__()
        self.ids, self.room, self.times, self.met = ids, room, times, bytearray(MARKS)
        self.latest: dict[str, bytes] = {}

    def seen(self, text: str) -> bytes:
        """The ids of a string that does not count as met."""
        own = self.get(text) or self.latest.get(text)
        if own is None:
            own = self.ids(text)
            if len(self.latest) >= LATEST:
                self.latest.clear()
            if len(text) < 100:
                self.latest[text] = own
        return own

    def __missing__(self, text: str) -> bytes:
        own, mark = self.seen(text), hash(text) % MARKS
        if self.met[mark] < self.times - 1:
            self.met[mark] += 1
        elif self.room > 0 and len(text) < 100:
            self[text] = own
            self.room -= MEMO_ENTRY + 2 * len(text) + len(own)
        return own


class Encoder:
    """The token ids (little-endian unsigned 32-bit) of texts.

    The tokenizer drops white space and never joins what white space parts, so a text's ids are those of its
    words in order. A new word of plain letters, where the tokenizer is made as stated above, has those of its pieces, for which only
    the tokenizer's model is asked; other words go to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first, *more = (made["pre_tokenizer"] or {}).get("pretokenizers") or [None]
        plain = made["model"]["type"] == "BPE" and (made["normalizer"] or {}).get("normalizers") == NORMALIZERS and first == SPLIT
        plain = plain and [(m["type"], m["add_prefix_space"], m["use_regex"]) for m in more] == [("ByteLevel", False, False)]
        plain = plain and not any(t["normalized"] for t in made["added_tokens"]) and not made["truncation"] and not made["padding"]
        odd = [f"[^{PLAIN}]", *(re.escape(t["content"]) for t in made["added_tokens"])]
        self.odd = re.compile("|".join(odd) if plain else "")
        self.words, self.pieces = Memo(self.word, WORD_BYTES, WORD_TIMES), Memo(self.piece, PIECE_BYTES, PIECE_TIMES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if self.odd.search(word):
            return self.whole(word)
        pieces = PIECE.findall(word.lower())
        if len(pieces) == 1:  # remembered as a word only
            return self.pieces.seen(pieces[0])
        return b"".join(map(self.pieces.__getitem__, pieces))

    def piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(BYTES)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}
_timers: list[threading.Timer] = []


def default_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Encoder:
    """The encoder of a file, which the worker keeps from task to task."""
    while _timers:
        _timers.pop().cancel()
    own = _encoders.get(path)
    if own is None:
        own = _encoders[path] = Encoder(path)
        released()
    return own


def forget() -> None:
    _encoders.clear()
    gc.collect()  # an encoder and its memos refer to each other
    released()


def forget_later() -> None:
    """Forgets the encoders unless the worker has another task of packing soon."""
    timer = threading.Timer(IDLE_S, forget)
    timer.daemon = True
    _timers.append(timer)
    timer.start()


class Queue:
    """Waiting pieces of one tier by length."""

    def __init__(self) -> None:
        self.by_length: dict[int, list] = {}
        self.lengths: list[int] = []

    def add(self, piece: tuple) -> None:
        n = len(piece[2])
        if n not in self.by_length:
            self.by_length[n] = []
            bisect.insort(self.lengths, n)
        self.by_length[n].append(piece)

    def pop(self, at: int) -> tuple:
        n = self.lengths[at]
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.by_length[n], self.lengths[at]
        return piece

    def longest(self, most: int) -> tuple | None:
        """The longest piece of at most so many tokens."""
        at = bisect.bisect_right(self.lengths, most) - 1
        return self.pop(at) if at >= 0 else None

    def longer(self, room: int) -> tuple | None:
        """The shortest piece of more tokens."""
        at = bisect.bisect_right(self.lengths, room)
        return self.pop(at) if at < len(self.lengths) else None


class Pool:
    """Waiting pieces (document, start, ids, tokens of the document) of one task in a queue for each tier, and the windows made of them."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.next_sequence, self.next_group = tiers, first_sequence, first_sequence
        self.queues = [Queue() for _ in tiers]
        self.full: list[tuple] = []
        self.pieces = self.tokens = 0

    def add(self, piece: tuple) -> None:
        """Routes a piece to the smallest tier that holds it."""
        n = len(piece[2])
        self.queues[bisect.bisect_left(self.tiers, n)].add(piece)
        self.pieces, self.tokens = self.pieces + 1, self.tokens + n

    def ready(self) -> bool:
        return self.pieces + len(self.full) >= POOL_PIECES or self.tokens + len(self.full) * self.tiers[-1] >= POOL_TOKENS

    def take(self, tier: int, room: int) -> tuple:
        """So many tokens at most: the longest piece that fits, from the tier itself or the shorter ones; else the beginning of one that is too long."""
        down = self.queues[tier::-1]
        piece = next((p for q in down if (p := q.longest(room))), None)
        if piece:
            self.pieces, self.tokens = self.pieces - 1, self.tokens - len(piece[2])
            return piece
        doc, start, ids, total = next(p for q in reversed(down) if (p := q.longer(room)))
        self.pieces, self.tokens = self.pieces - 1, self.tokens - len(ids)
        self.add((doc, start + room, ids[room:], total))
        return doc, start, ids[:room], total

    def windows(self) -> Iterator[tuple[int, list]]:
        """All waiting pieces, as windows (length, pieces): tier by tier from the longest, each gap filled from the tier and then the shorter ones."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.queues[tier].lengths:
                window = self.tiers[tier]
                if self.tokens < window:  # the last ones: powers of two without a gap
                    window = 1 << (self.tokens.bit_length() - 1)
                room, inside = window, []
                while room:
                    piece = self.take(tier, room)
                    inside.append(piece)
                    room -= len(piece[2])
                yield window, inside

    def packed(self) -> list[tuple]:
        """Rows of all waiting pieces and full windows, with step groups of like cost."""
        made = [*((self.tiers[-1], [piece]) for piece in self.full), *self.windows()]
        self.full = []
        groups = max(1, -(-len(made) // STEP_WINDOWS))
        made.sort(key=lambda w: -sum(len(p[2]) ** 2 for p in w[1]))
        rows = []
        for i, (window, inside) in enumerate(made):
            lap, at = divmod(i, groups)
            rows += self.rows(window, inside, self.next_group + (groups - 1 - at if lap % 2 else at))
        self.next_group += groups
        return rows

    def rows(self, window: int, inside: list, group: int) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in inside:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_sequence, offset, window, group))
            offset += len(ids)
        self.next_sequence += 1
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step_group.

    `tiers` are powers of two; a sequence never has a gap. A null text is the empty text, whose ids are
    the end id alone. Ids may be null or occur again: each row of docs gives its own pieces. Other columns are not read.
    """
    path = tokenizer_file or default_tokenizer_file()
    longest = tiers[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        pool = Pool((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, tiers)
        out: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
                ids = np.frombuffer(encode(text) + end, "<u4")
                doc = None if doc is None or doc != doc else int(doc)
                full = len(ids) // longest * longest
                for start in range(0, full, longest):
                    pool.full.append((doc, start, ids[start : start + longest], len(ids)))
                    if pool.ready():
                        out += pool.packed()
                if full < len(ids):
                    pool.add((doc, full, ids[full:], len(ids)))
                if pool.ready():
                    out += pool.packed()
            if out:
                yield frame(out)
                out = []
        if pool.pieces or pool.full:
            yield frame(pool.packed())
        del pool
        released()
        forget_later()

    return short_batches(docs).select(docs[id_col].cast("long").alias("id"), plain_text(docs[text_col]).alias("text")).mapInPandas(run, SCHEMA)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return out.astype({"doc_id": "Int64"})


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null text has the end id alone, every row its own pieces, ids may be null or occur again; other columns are not read."""
    return pack(table(spark, sf_dir, "documents"))
