"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut into pre-tokens; each pre-token starts as its UTF-8 bytes, and the adjacent pair
of lowest rank is merged until no pair has a rank. The number of tokens is the number of bytes
minus the number of merges, so no identifier is ever looked up or emitted.

Null texts count as empty (0 tokens). Repeated rows are counted one by one; columns other than
the key and the text are ignored. A text's length is bounded by memory alone.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import require, text_or_empty

#: Distinct words whose counts a Python worker remembers in each of two generations.
CACHE_WORDS = 700_000
#: The pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNUSUAL_SPACE = re.compile(r"[^\S \n]|\s\s|^\s|\s\Z")


def printable_bytes() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens of texts under the merge ranks of a ``tokenizers`` JSON file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        self.symbols = printable_bytes()
        self.pieces = regex.compile(PRE_TOKENS)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.limit = cache_words
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged_length(self, piece: str) -> int:
        """Symbols that are left of one pre-token after all merges."""
        parts: list[str | None] = [self.symbols[b] for b in piece.encode()]
        size = len(parts)
        if size < 2:
            return size
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(size - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = size
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= size or parts[j] != b:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = a + b, None
            left -= 1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return left

    def __missing(self, word: str) -> int:
        if (n := self.old.get(word)) is None:
            n = 0
            for piece in self.pieces.findall(word):
                if piece == word:
                    n = self.merged_length(piece)
                    break
                n += self.word(piece)
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[word] = n
        return n

    def word(self, word: str) -> int:
        """Tokens of a stretch without inner white space, remembered."""
        n = self.young.get(word)
        return self.__missing(word) if n is None else n

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        if _UNUSUAL_SPACE.search(text):
            return sum(map(self.word, re.findall(r" ?\S+|\s+(?!\S)|\s+", text)))
        lines = text.split("\n")
        total = (len(lines) - 1) * self.word("\n")
        known, word = self.young.get, self.word
        for line in lines:
            first, *rest = line.split(" ")
            total += word(first)
            for w in rest:
                w = " " + w
                n = known(w)
                if n is None:
                    n = word(w)
                    known = self.young.get
                total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token, as the library has it."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        rest = self.special.split(text)
        return len(rest) - 1 + sum(map(self.plain, rest))


_COUNTERS: dict[str, MergeCounter] = {}


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens of ``text`` under the vocabulary file at ``vocabulary``.

    The file has to be at that path on every executor. A worker keeps its counter, and what it
    remembers of words, between tasks; that memory is bounded by ``CACHE_WORDS``.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, MergeCounter(vocabulary))
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(F.coalesce(text, F.lit("")))


def count_tokens(documents: DataFrame, vocabulary: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_tokens, and whether the row has more than ``limit`` tokens."""
    require(documents, (key, text))
    counted = documents.select(F.col(key), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), token_count(F.col(text), vocabulary).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
