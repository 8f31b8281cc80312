"""Byte-pair encoding and decoding by batched merge rounds in numpy.

The symbols of many distinct words lie in one flat array. A round looks up every neighbouring pair in
the sorted keys of the merge table by binary search, takes in each word the pair of the lowest rank,
at its leftmost place, and merges it; words without a pair in the table are done. Words that a task
has met before come from its cache, which is emptied when it is full.

The vocabulary file is a parameter. It is read from ``path`` where that is a local file on the driver
and its contents travel to the tasks, a few MB, whatever the data.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import ranges, slices, texts

#: Words that a task remembers.
CACHE_WORDS = 200_000
#: Text bytes whose words are held at once.
BATCH = 2 << 20
# Up to U+024F texts are in composed form and their case has the same rules everywhere.
_PLAIN_END = 0x250
_FURTHER = re.compile(r"[^\u0000-\u024F]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next one from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _class(kinds: str) -> str:
    """The inside of a character class: plain code points whose category begins with ``kinds``, or
    white space."""
    wanted = [
        c for c in range(_PLAIN_END)
        if (chr(c) in "\t\n\x0b\x0c\r \x85\xa0" if kinds == "space" else unicodedata.category(chr(c))[0] == kinds)
    ]
    cuts = [i for i in range(len(wanted)) if i == 0 or wanted[i] != wanted[i - 1] + 1]
    spans = [(wanted[a], wanted[b - 1]) for a, b in zip(cuts, [*cuts[1:], len(wanted)])]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


class WordBpe:
    """A vocabulary whose words end in a suffix: lower case, white space dropped."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.spec = spec
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        letter, number, space = _class("L"), _class("N"), _class("space")
        self.words_at = re.compile(
            f"[{letter}]+|[{number}]|'s|'t|'re|'ve|'m|'ll|'d|[^{space}{letter}{number}]+"
        )
        self._slow = None
        self.cache: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        """Forget all words. Word ``i`` has ``ids[starts[i] : starts[i] + lengths[i]]``."""
        self.cache.clear()
        self.ids = np.zeros(0, np.int64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of tokens of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word = [], []
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], len(self.merged))
            rank = np.append(rank, len(self.merged))
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(word)))
            best = np.repeat(lowest, size)
            open_ = best < len(self.merged)
            if not open_.all():
                done_ids.append(symbols[~open_])
                done_word.append(word[~open_])
                symbols, word, rank, best = symbols[open_], word[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            # All places of the lowest pair in a word merge, from the left, none overlapping.
            hit = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        ids = ids[np.argsort(word, kind="stable")]
        return ids, np.bincount(word, minlength=len(words))

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens, as the file's own steps cut them."""
        # Some letters below U+0250 have their lower case beyond.
        lower = text.lower()
        if text.isascii() or not (_FURTHER.search(text) or _FURTHER.search(lower)):
            return self.words_at.findall(lower)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.spec)
            self._letter = {c: b for b, c in enumerate(byte_letters())}
        line = self._slow.normalizer.normalize_str(text)
        pieces = self._slow.pre_tokenizer.pre_tokenize_str(line)
        return [bytes(self._letter[c] for c in piece).decode() for piece, _ in pieces]

    def _parts(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens, in order."""
        if self.special_at is None or not any(s in text for s in self.special):
            return self._words(text)
        out: list[str | int] = []
        at = 0
        for m in self.special_at.finditer(text):
            out += self._words(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._words(text[at:])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit integers."""
        parts = [self._parts(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self._clear()
        cache = self.cache
        fresh = [w for w in dict.fromkeys(w for p in parts for w in p) if w not in cache]
        if fresh:
            plain = [w for w in fresh if isinstance(w, str)]
            ids, counts = self.merge_words([w.encode() for w in plain])
            codes = [w for w in fresh if not isinstance(w, str)]
            counts = np.concatenate((counts, np.ones(len(codes), np.int64)))
            base = len(self.starts)
            cache.update(zip([*plain, *codes], range(base, base + len(fresh))))
            first = len(self.ids) + np.concatenate(([0], np.cumsum(counts)[:-1]))
            self.ids = np.concatenate((self.ids, ids, np.array(codes, np.int64)))
            self.starts = np.concatenate((self.starts, first))
            self.lengths = np.concatenate((self.lengths, counts))
        out = []
        for p in parts:
            number = np.fromiter(map(cache.__getitem__, p), np.int64, len(p))
            out.append(self.ids[ranges(self.starts[number], self.lengths[number])].astype("<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of ``ids`` with a space between them, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def vocabulary(path: str) -> str:
    """The contents of a vocabulary file on the driver."""
    return Path(path).read_text()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids``: the token ids of each text as little-endian unsigned 32-bit integers.

    Null text: empty. Repeated rows come back as often as they went in; other columns are ignored.
    """
    spec = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(spec)
        for batch in slices(batches, limit=BATCH):
            ids = [x.tobytes() for x in model.encode_batch(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, text``: the decoded text beside the ids of ``encode``."""
    spec = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(spec)
        for batch in slices(batches, "ids", BATCH):
            out = [model.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.string())], ["doc_id", "ids", "text"]
            )

    return tokens.mapInArrow(run, "doc_id long, ids binary, text string")
