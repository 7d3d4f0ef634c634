"""Packing: sum-of-squares online packing of token sequences into fixed windows.

Documents are tokenised and closed by an end token.  Whole windows are cut off a long document;
its rest is placed online: with N(h) windows filled to level h, tracked in a level array, it goes to
the level (or a new window) after which the sum of N(h)**2 over partly filled levels is least.  At a
part's end, or when more than ``max_open`` windows are open, the open windows are drained: their
pieces are laid end to end and cut at window borders, and what is left over is cut at powers of two,
which need no padding.  So memory is bounded by ``max_open`` windows and the text at hand.

Each input partition packs by itself in one pass and without a shuffle: a lost task is repeated on
the same rows with the same result.  Null text reads as empty (the end token alone); rows that
repeat are packed each; an empty table gives no rows.  A sequence number is the partition's number
times 2**33 plus a counter.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class LevelArray:
    """Open windows by level, and the level that the sum-of-squares rule picks."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.at: dict[int, list[int]] = {}

    def best(self, size: int) -> int:
        """Level that takes ``size`` (0: a new window); ties go to the fuller window.

        Moving a window from level h to h + size changes the sum of squares by
        1 - 2 N(h) and, unless that fills the window, by 1 + 2 N(h + size).
        """
        n = self.count
        last = self.window - size
        change = 1 - 2 * n[: last + 1]
        change[0] = 0
        change[:last] += 1 + 2 * n[size : self.window]
        change[1:][n[1 : last + 1] == 0] = np.iinfo(np.int64).max
        least = int(change.min())
        return last - int(np.argmax(change[::-1] == least))

    def take(self, level: int) -> int:
        """Remove and return a window of that level."""
        stack = self.at[level]
        self.count[level] -= 1
        return stack.pop()

    def put(self, level: int, window: int) -> None:
        if level < self.window:
            self.count[level] += 1
            self.at.setdefault(level, []).append(window)


class TokenCache:
    """Token ids of texts as little-endian bytes, by way of a table of pieces seen before.

    For tokenizers whose own settings are ``SETTINGS``: they lower-case, cut at letters, single digits
    and runs of other signs, and map bytes to letters before their merges.  Where a text has code
    points up to U+00FF only, these steps are done here and each new piece goes straight to the merges;
    other blank-separated words, and texts that hold special tokens, go to the tokenizer itself, as all
    texts do if its settings are others.  Pieces of up to ``longest`` characters are kept, and the table
    starts anew after ``most`` of them.
    """

    # The settings of the public tokenizer for which the steps below are the same.
    SETTINGS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    SPECIAL = "<|"
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa00-9²³¹¼-¾a-zªµºß-öø-ÿ]+")

    def __init__(self, tokenizer, most: int = 400_000, longest: int = 48) -> None:
        self.tokenizer, self.model, self.most, self.longest = tokenizer, tokenizer.model, most, longest
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}
        own = json.loads(tokenizer.to_str())
        self.fits = all(own[k] == v for k, v in self.SETTINGS.items()) and all(self.SPECIAL in x["content"] for x in own["added_tokens"])

    def piece(self, x: str) -> bytes:
        mapped = x if x.isascii() and x.isalpha() else "".join([self.letter[b] for b in x.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def whole(self, x: str) -> bytes:
        return array("I", self.tokenizer.encode(x, add_special_tokens=False).ids).tobytes()

    def fill(self, pieces: list[str]) -> bytes:
        known, out = self.known, []
        for x in pieces:
            ids = known.get(x)
            if ids is None:
                ids = self.piece(x)
                if len(x) <= self.longest:
                    known[x] = ids
            out.append(ids)
        return b"".join(out)

    def latin(self, text: str) -> bytes:
        pieces = self.PIECE.findall(text.lower())
        try:
            return b"".join([self.known[x] for x in pieces])
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            return self.fill(pieces)

    def ids(self, text: str) -> bytes:
        if not self.fits or self.SPECIAL in text:
            return self.whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join([self.latin(x) if x.isascii() else self.whole(x) for x in text.replace("\n", " ").split(" ")])
        return self.latin(text)


def _cache(path: str) -> TokenCache:
    """One table for each Python worker and tokenizer file, kept from task to task."""
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_tessera_token_caches", types.ModuleType("_tessera_token_caches"))
    if path not in vars(kept):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vars(kept)[path] = TokenCache(Tokenizer.from_file(path))
    return vars(kept)[path]


class Packer:
    """Packs one partition's documents; ``add`` and ``finish`` yield pieces as they become final."""

    def __init__(self, first: int, window: int = WINDOW, max_open: int = 1024) -> None:
        self.levels, self.window, self.next, self.max_open = LevelArray(window), window, first, max_open
        self.open: dict[int, list[tuple]] = {}

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total, at, w = len(ids), 0, self.window
        while total - at >= w:
            yield doc_id, at, w, ids[at : at + w], total, self.number(), 0
            at += w
        size = total - at
        if not size:
            return
        level = self.levels.best(size)
        window = self.levels.take(level) if level else self.number()
        pieces = self.open.setdefault(window, [])
        pieces.append((doc_id, at, size, ids[at:].copy(), total, window, level))
        self.levels.put(level + size, window)
        if level + size == w:
            yield from self.open.pop(window)
        elif len(self.open) > self.max_open:
            yield from self.drain()

    def drain(self) -> Iterator[tuple]:
        """Lay the open windows' pieces end to end; every sequence but the last ones is full."""
        waiting = [p for pieces in self.open.values() for p in pieces]
        self.levels, self.open = LevelArray(self.window), {}
        left = sum(p[2] for p in waiting)
        room, level, number = 0, 0, -1
        for doc_id, start, size, ids, total, _, _ in waiting:
            at = 0
            while at < size:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    number, level = self.number(), 0
                part = min(room, size - at)
                yield doc_id, start + at, part, ids[at : at + part], total, number, level
                at, room, level, left = at + part, room - part, level + part, left - part


def _pack(path: str, end_id: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        packer = Packer(TaskContext.get().partitionId() << 33, window)
        names = [x.split()[0] for x in PIECES.split(", ")]
        end = np.array([end_id], dtype="<u4").tobytes()

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            cols[3] = [x.tobytes() for x in cols[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names)

        done: list[tuple] = []
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for i in range(b.num_rows):
                found = np.frombuffer(cache.ids(texts[i].as_py() or "") + end, dtype="<u4")
                for piece in packer.add(ids[i].as_py(), found):
                    done.append(piece)
                    if len(done) >= 1024:
                        yield batch(done)
                        done = []
        for piece in packer.drain():
            done.append(piece)
            if len(done) >= 1024:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of ``docs`` in windows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    shared.shared_dir(docs.sparkSession)
    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, end_id, window), PIECES)


def _ranks(path: str):
    """One encoding of a rank file for each Python worker, kept from task to task."""
    import base64

    import public_tokenizers
    import tiktoken

    kept = sys.modules.setdefault("_tessera_token_caches", types.ModuleType("_tessera_token_caches"))
    if path not in vars(kept):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        vars(kept)[path] = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return vars(kept)[path]


def _lengths(word_path: str, byte_path: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ranks = _cache(word_path), _ranks(byte_path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            word, byte = [], []
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                word.append(len(cache.ids(text)) // 4)
                byte.append(len(ranks.encode_ordinary(text)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(word, pa.int64()), pa.array(byte, pa.int64())], names)

    return run


def token_lengths(docs: DataFrame, word_path: str, byte_path: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with word_tokens and byte_tokens: tokens of the whole text under a tokenizer file like :func:`pack`'s and under a rank file; 0 for null or empty text."""
    shared.shared_dir(docs.sparkSession)
    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_lengths(word_path, byte_path, [*keep, "word_tokens", "byte_tokens"]), f"{kinds}, word_tokens long, byte_tokens long")
