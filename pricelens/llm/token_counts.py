"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix decides the rest: the tokens of text[:i] are those of text[:i - len(t)] and then t, where t
is the one token that ends there and may follow the last token of that shorter prefix. "May follow" is a property of
the pair alone: merging the two tokens' characters gives the same two tokens. So one pass stores the count of every
prefix, and questions about budgets and truncation are answered from the stored counts without encoding again."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField

from pricelens.llm.common import append, texts

SPACE = "▁"
#: Words, and prefixes or pairs of tokens, whose answers a task remembers: as many again that were used before them.
WORDS = 600_000
REMEMBERED = 250_000
#: A longer run without a space is computed each time, so that what is remembered stays small.
LONGEST_REMEMBERED = 48


class Recent(dict):
    """Remembers what was used lately: when it is full it becomes the older part, and what is used again moves over.
    What is in neither part is made anew; `make` stores what is worth it."""

    def __init__(self, most: int, make=lambda key: None):
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            return self.make(key)
        self[key] = found
        return found

    def __setitem__(self, key, value):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        super().__setitem__(key, value)


class PrefixCounter:
    """Counts for a merge model with one space mark before the text, no other normalisation, and byte fallback."""

    def __init__(self, model: bytes):
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(pieces.get_piece_size())
        self.rank = {
            pieces.id_to_piece(i): (-pieces.get_score(i), i)
            for i in ids
            if not (pieces.is_byte(i) or pieces.is_control(i) or pieces.is_unknown(i))
        }
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("a piece holds a space after other characters, or a line end")
        self.tokens = {p for p in self.rank if len(p) == 1 or self.merged(p) == [p]}
        # lengths of the tokens with the same last two or three characters, the longest first
        self.pair_ends = {t: (2,) for t in self.tokens if len(t) == 2}
        ends: dict[str, set[int]] = {}
        for t in self.tokens:
            if len(t) > 2:
                ends.setdefault(t[-3:], set(self.pair_ends.get(t[-2:], ()))).add(len(t))
        self.ends = {end: tuple(sorted(lengths, reverse=True)) for end, lengths in ends.items()}
        self.words = Recent(WORDS, self.word)
        self.states = Recent(REMEMBERED)  # a prefix's count, last token and the state before: for all words that begin so
        self.pairs = Recent(REMEMBERED)

    def merged(self, text: str) -> list[str]:
        """Merges of a short text: the best score first, then the leftmost."""
        symbols = list(text)
        while True:
            best = None
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1])
                if rank and (best is None or rank[0] < best[0]):
                    best = (rank[0], i)
            if best is None:
                return symbols
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs[key]
        if known is None:
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def prefix_counts(self, word: str) -> list[int]:
        """The number of tokens of each prefix of 1, 2, ... characters. Starts at the longest prefix known."""
        n = len(word)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        states, tokens, known, ends, pair_ends = self.states, self.tokens, self.pairs.get, self.ends, self.pair_ends
        at, state = min(n, LONGEST_REMEMBERED), None
        while at and (state := states[word[:at]]) is None:
            at -= 1
        chain = state
        for i in range(at, 0, -1):
            counts[i], last[i], chain = chain
        for i in range(at + 1, n + 1):
            for length in ends.get(word[i - 3 : i]) or pair_ends.get(word[i - 2 : i], ()):
                start = i - length
                if start >= 0 and (token := word[start:i]) in tokens:
                    if not start:
                        break
                    fits = known((last[start], token))
                    if fits or fits is None and self.may_follow(last[start], token):
                        break
            else:
                start, token = i - 1, word[i - 1]
            cost = 1 if token in tokens else len(token.encode())
            counts[i], last[i] = counts[start] + cost, token
            if i <= LONGEST_REMEMBERED:
                state = states[word[:i]] = counts[i], token, state
        return counts[1:]

    def word(self, word: str) -> bytes:
        """The counts as 32-bit numbers."""
        found = np.array(self.prefix_counts(word), np.int32).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            self.words[word] = found
        return found

    def texts(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of all texts, from the empty prefix on, and where each text starts."""
        found, firsts, lengths = [], [], []
        for text in many:
            firsts.append(len(found))
            lengths.append(len(text) + 1)
            found += map(self.words.__getitem__, _WORDS.findall(SPACE + text.replace(" ", SPACE)))
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        if not many:
            return np.zeros(0, np.int32), starts
        counts = np.frombuffer(b"".join(found), np.int32).copy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ends = np.cumsum(counts[np.cumsum(sizes) - 1], dtype=np.int64)
        before = np.concatenate([[0], ends[:-1]])
        first = np.array(firsts)
        words = np.diff(np.append(first, len(found)))
        before -= np.repeat(before[first], words)
        counts += np.repeat(before, sizes).astype(np.int32)
        counts[starts[:-1]] = 0  # the mark alone stands for the empty prefix
        return counts, starts


#: Parts that no token crosses: spaces with the word after them, or a line end.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@lru_cache(maxsize=2)
def counter(model: bytes) -> PrefixCounter:
    return PrefixCounter(model)


def prefix_counts(df: DataFrame, model: bytes, *, text: str = "text", counts: str = "prefix_tokens") -> DataFrame:
    """Adds `prefix_tokens` array<int>: element k (from 0) is the token count of the first k code points.

    A null text counts as empty, which gives [0]. Repeated rows stay. Other columns stay; one named like the new column
    is replaced. Counts can fall from one prefix to the next, as a character may complete a longer token. `model`
    holds the bytes of a model file; it is sent to each task."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        known = counter(sent.value)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            values, starts = known.texts(texts(part, text))
            return [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))]

        return work

    return append(df, text, [StructField(counts, ArrayType(IntegerType()))], make, most=1 << 20)


def n_tokens(counts: str = "prefix_tokens") -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def tokens_of_prefix(length: Column, counts: str = "prefix_tokens") -> Column:
    """Tokens of the first `length` code points; of the whole text where it is shorter."""
    return F.element_at(counts, F.least(length + 1, F.size(counts)).cast("int")).cast("long")


def longest_prefix(budget: int, counts: str = "prefix_tokens") -> Column:
    """Code points of the longest prefix with at most `budget` tokens."""
    fits = F.transform(counts, lambda x, i: F.when(x <= budget, i).otherwise(0))
    return F.array_max(fits).cast("long")
