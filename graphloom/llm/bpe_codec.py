"""Byte-pair encoding by backtracking over longest matches, and decoding by a table of offsets.

An Aho-Corasick automaton of the vocabulary finds, in one pass over a pre-token, the longest token that
starts at each byte. The encoder takes the longest one that is compatible with the token before it; where
none is, it steps back one token, which is then tried shorter. Two tokens are compatible if merging
their joined bytes gives just these two; verdicts on pairs are kept in a table. A byte from which no
sequence could go on is marked and never entered again, so the work is linear in the length of a pre-token. The
result is the sequence that merging by rank gives.

Texts of common scripts are cut into pre-tokens here; one with any other character is cut by the
library's own pre-tokeniser, as tables of Unicode differ. Special strings inside a text become their one
id, as the library has it by default.

Decoding copies the bytes of each id from one buffer by a table of offsets, all ids at once; bytes that
are no UTF-8 become U+FFFD.

Null texts are empty: no ids, the empty text. Rows are encoded one by one, so keys may repeat or be
null, and ties can't arise. Columns other than key and text are ignored, whatever their names. A text, its ids
and its bytes are held by one task, however long. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import require
from graphloom.llm.token_count import printable_bytes

#: Pre-tokens that a Python worker remembers in each of two generations (about 200 bytes each), and pairs of tokens.
CACHE_WORDS, CACHE_PAIRS = 500_000, 500_000
#: Longer pre-tokens are not remembered.
LONG_WORD = 64
#: Scripts whose classes no table of Unicode changed, without numbers other than digits and odd separators.
_COMMON = re.compile(r"[\t\n\r -~¡-±´-¸º»¿-ͷЀ-ԯぁ-ゖァ-ヺ一-龥가-힣‐-‧、-〃！-～]*")
#: The pre-token pattern of the byte-level vocabulary, for these scripts.
_PIECES = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class ByteCodec:
    """Ids of a text as little-endian unsigned 32-bit integers, and the text of ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.shown = printable_bytes()
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = sorted(self.special, key=len, reverse=True)
        self.is_special = re.compile("(" + "|".join(map(re.escape, named)) + ")") if named else None
        self.library = Tokenizer.from_file(path)
        # Tokens are numbered by rank inside: the single bytes, then one for each merge.
        self.order = {c: i for i, c in enumerate(self.shown)}
        self.joined: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(256)]
        for a, b in merges:
            made = len(self.halves)
            if a + b not in self.order and a in self.order and b in self.order:
                self.order[a + b] = made
                self.halves.append((self.order[a], self.order[b]))
                self.joined[self.halves[-1]] = made
        tokens = list(self.order)
        self.size = [len(t) for t in tokens]
        self.id = np.array([vocabulary[t] for t in tokens], "<u4")
        self.automaton = ahocorasick.Automaton()
        for t, number in self.order.items():
            self.automaton.add_word(t, number)
        self.automaton.make_automaton()
        #: The longest token that begins a token, other than itself.
        self.shorter = [next((self.order[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.order), -1) for t in tokens]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Decoding: bytes of all ids in one buffer, those of id i from offset i to offset i + 1.
        value = {c: b for b, c in enumerate(self.shown)}
        texts = {i: bytes(map(value.__getitem__, t)) for t, i in vocabulary.items()}
        texts |= {i: t.encode() for t, i in self.special.items()}
        content = [texts.get(i, b"") for i in range(max(texts) + 1)]
        self.buffer = np.frombuffer(b"".join(content), "u1")
        self.offsets = np.concatenate([[0], np.cumsum([len(c) for c in content])])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two."""
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        verdict = self.compatible[left, right] = self._undisturbed(left, right)
        return verdict

    def _undisturbed(self, left: int, right: int) -> bool:
        # Undoes the merges of both sides from the latest on: at each moment no pair over the border may
        # have a rank before the merge that is undone next on either side.
        bound = len(self.halves)
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            if left >= 256 and (left > right or right < 256):
                bound, left = left, self.halves[left][1]
            elif right >= 256:
                bound, right = right + 1, self.halves[right][0]
            else:
                return True

    def word(self, shown: str) -> bytes:
        """Ids of one pre-token, its bytes written as printable characters."""
        if (whole := self.order.get(shown)) is not None and self.reachable(whole):
            return self.id[whole : whole + 1].tobytes()
        size, sizes, shorter, compatible = len(shown), self.size, self.shorter, self.compatible
        longest = [-1] * size
        for end, number in self.automaton.iter(shown):  # by end; of these the longest first, so the longest of a start comes last
            longest[end + 1 - sizes[number]] = number
        tokens: list[int] = []
        dead = bytearray(size + 1)
        at, token = 0, longest[0]
        while at < size:
            before = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + sizes[token]
                if not dead[end] and (before < 0 or (fit if (fit := compatible.get((before, token))) is not None else self.fits(before, token))):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                dead[at] = 1
                token = tokens.pop()
                at -= sizes[token]
        return self.id[tokens].tobytes()

    def reachable(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        a, b = self.halves[token]
        return a == b and token < 256 or self.whole_halves(a, b, token)

    def whole_halves(self, a: int, b: int, token: int) -> bool:
        # No pair over the border of the halves may merge before they are whole.
        saved = self.joined.pop((a, b))
        try:
            return self._undisturbed(a, b) and self.reachable(a) and self.reachable(b)
        finally:
            self.joined[a, b] = saved

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            return self.word(piece.replace(" ", self.shown[32]))
        return self.word("".join(map(self.shown.__getitem__, piece.encode())))

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if _COMMON.fullmatch(text):
            pieces, ids_of = _PIECES.findall(text), self.piece
        else:  # marked, as these are written in printable characters
            pieces, ids_of = ["\0" + shown for shown, _ in self.library.pre_tokenizer.pre_tokenize_str(text)], self.marked
        new = set(pieces).difference(self.young)
        if new:
            if len(self.young) + len(new) > CACHE_WORDS:
                self.old, self.young = self.young, {}
                new = set(pieces)
            young, old = self.young, self.old
            for piece in new:
                young[piece] = old.get(piece) or ids_of(piece)
        ids = b"".join(map(self.young.__getitem__, pieces))
        for piece in new:
            if len(piece) > LONG_WORD:
                del self.young[piece]
        return ids

    def marked(self, piece: str) -> bytes:
        return self.word(piece[1:])

    def encode(self, text: str) -> bytes:
        if self.is_special is None or not self.is_special.search(text):
            return self.plain(text) if text else b""
        parts = self.is_special.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.plain(p) if p else b"" for p in parts)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8."""
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.offsets[numbers]
        sizes = self.offsets[numbers + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        content = self.buffer[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)].tobytes()
        try:
            content.decode()
        except UnicodeDecodeError:
            return content.decode("utf-8", "replace").encode()
        return content


_CODECS: dict[str, ByteCodec] = {}
#: Rows handed on together; a batch holds texts of about this many bytes at most, or one text.
ROWS_TOGETHER, BYTES_TOGETHER = 1000, 16 << 20


def encoded(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_content: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row and, ``with_content``, the ids themselves
    (little-endian unsigned 32 bit) and the decoded text.

    The vocabulary file has to be at that path on every executor; a worker keeps its codec between tasks.
    """
    require(documents, (key, text))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(vocabulary) or _CODECS.setdefault(vocabulary, ByteCodec(vocabulary))
        names = ["_key", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            types[0] = batch.schema.field(0).type
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = codec.encode(content.as_py())
                decoded = codec.decode(ids)
                rows.append((name, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if with_content else None, decoded.decode() if with_content else None))
                held += len(ids) + len(decoded) if with_content else 0
                if len(rows) >= ROWS_TOGETHER or held > BYTES_TOGETHER:
                    yield out()
                    held = 0
        if rows:
            yield out()

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).mapInArrow(task, f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    out = out.withColumnRenamed("_key", key)
    return out if with_content else out.drop("ids", "decoded")
