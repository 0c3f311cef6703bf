"""Packing of tokenised documents into windows by multiway differencing.

Each task takes its rows in order. Of every document it cuts off full windows first; what is left, the
tail, is cut into parts of ``PART`` ids and a shorter one. Parts are gathered into groups that fill
``GROUP_WINDOWS`` windows but for ``SPARE`` ids each (the part at the boundary is cut there, and its
rest opens the next group). A group's parts go to windows by Karmarkar-Karp multiway differencing:
partial partitions with opposing imbalances are merged, the widest first, until one partition into
near-equal windows is left. If a window is over capacity, the number of windows rises by one, and all
is done anew. Nothing is moved or cut afterwards. Of what is read, about one percent is padding.

Nothing is shuffled: groups are made of neighbouring rows, and a lost task yields the same rows
again. Null texts are empty documents (the end id alone). Rows are packed one by one, so keys may be
equal or null; ties in length go by the order of rows. Columns other than key and text are ignored,
whatever their names. Of a very long text, one task holds the text and its ids. An empty table gives no
rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import give_back, require
from graphloom.llm.token_count import printable_bytes

#: The most ids of a part, the windows of a group, and the ids that each is meant to lack.
PART, GROUP_WINDOWS, SPARE = 512, 64, 16
#: Distinct words whose ids a Python worker remembers in each of two generations, unless another number is given
#: (about 200 bytes each).
CACHE_WORDS = 600_000
#: The parts into which the vocabulary cuts a word.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Latin-1 bytes whose case, form or class two Unicode tables could see differently.
_UNSURE = bytes([*range(0x1C, 0x20), 0xB2, 0xB3, 0xB5, 0xB9, 0xBC, 0xBD, 0xBE])


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Indices of ``lengths`` dealt to ``windows`` lists of near-equal sums.

    A partial partition holds its sums in falling order, without those that are 0, and what makes each up:
    an index or a pair of such. Two of them are merged so that the fullest of one meets the emptiest of
    the other; while there are empty windows for both, none is added to another.
    """
    order = itertools.count()
    heap = [(-n, next(order), [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = max(0, len(a) + len(b) - windows)
        alone = a[: len(a) - both] + b[: len(b) - both]
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)]
        total = sorted(alone + met, key=_sum, reverse=True)
        least = total[-1][0] if len(total) == windows else 0
        heapq.heappush(heap, (least - total[0][0], next(order), total))
    out: list[list[int]] = []
    for _, made in heap[0][2] if heap else ():
        own, waiting = [], [made]
        while waiting:
            part = waiting.pop()
            if isinstance(part, tuple):
                waiting += part
            else:
                own.append(part)
        out.append(own)
    return out + [[] for _ in range(windows - len(out))]


_sum = operator.itemgetter(0)


def windows_of(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths``, none over ``capacity``, dealt to near-equal windows within it."""
    count = max(1, -(-sum(lengths) // capacity))
    dealt = differencing(lengths, count)
    while max(sum(lengths[i] for i in w) for w in dealt) > capacity:
        count += 1
        dealt = differencing(lengths, count)
    return [w for w in dealt if w]


def tail_parts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the parts of what full windows leave of a document."""
    size = min(PART, capacity)
    return [(start, min(size, length - start)) for start in range(length - length % capacity, length, size)]


class WordIds:
    """Ids of texts as the library gives them, as little-endian unsigned 32-bit integers.

    The vocabulary ignores case and never joins symbols over white space, so ids of a word
    between white space are looked up once. Texts with characters for which two Unicode tables
    could differ are left to the library whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        #: The same model, held once, for parts that are cut and in lower case already.
        self.of_parts = Tokenizer(self.library.model)
        self.of_parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.shown = printable_bytes()
        self.shown[32] = " "
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.parts = re.compile(WORD_PARTS)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.limit = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def unseen(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from one call: every part of a word ends with an id of ``last``."""
        cut = [(w,) if w.isalpha() else self.parts.findall(w) for w in words]
        line = " ".join(itertools.chain.from_iterable(cut))
        if not (line.isascii() and line.isprintable()):  # bytes as the vocabulary writes them; for printable ASCII these are the characters
            line = "".join(map(self.shown.__getitem__, line.encode()))
        encoded = self.of_parts.encode_batch_fast([line], add_special_tokens=False)
        ids = np.array(encoded[0].ids, "<u4")
        ends, parts = np.flatnonzero(self.last[ids]) + 1, np.cumsum([len(c) for c in cut])
        if len(ends) != parts[-1] or not all(cut):  # parts that the library would cut further: word by word
            return [self.whole(w).tobytes() for w in words]
        ends = ends[parts - 1]
        content, ends = ids.tobytes(), (4 * ends).tolist()
        return [content[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def simple(self, text: str) -> bool:
        """Whether white space and case of the text are beyond doubt, and no special string is in it."""
        if not text.isascii():
            try:
                content = text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        else:
            content = text.encode()
        return len(content.translate(None, _UNSURE)) == len(content) and not any(s in text for s in self.specials)

    def ids(self, text: str) -> bytes:
        if not self.simple(text):
            return self.whole(text).tobytes()
        words = text.lower().split()
        if new := set(words).difference(self.young):
            if len(self.young) + len(new) > self.limit:
                self.old, self.young = self.young, {}
                new = set(words)
            self.learn(new)
        return b"".join(map(self.young.__getitem__, words))

    def learn(self, new: set[str]) -> None:
        young, old = self.young, self.old
        for mark in ",.":
            if mark not in young:
                young[mark] = self.unseen([mark])[0]
        unseen = []
        for w in new:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            elif w[-1] in ",." and w[-2:-1].isalpha():  # a mark after a letter is a part of its own
                if (ids := young.get(w[:-1]) or old.get(w[:-1])) is not None:
                    young[w] = ids + young[w[-1]]
                else:
                    unseen.append(w)
            else:
                unseen.append(w)
        if unseen:
            young.update(zip(unseen, self.unseen(unseen), strict=True))


@functools.cache
def word_ids(vocabulary: str, cache_words: int) -> WordIds:
    """The one of a worker, for all of its tasks. Tasks refer to this by its name; a dictionary they refer to would come to each as a copy."""
    return WordIds(vocabulary, cache_words)


#: Rows handed on together; each holds up to a window of ids.
ROWS_TOGETHER = 250
PIECES = "{key} {type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(documents: DataFrame, vocabulary: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    ``with_ids``, the ids themselves (little-endian unsigned 32 bit).

    ``sequence_id`` holds the partition in its upper bits, so it is the same if a task is run
    again, and rises with the order of rows from group to group. ``cache_words`` trades memory of a worker
    for time.
    """
    require(documents, (key, text))
    end = np.array([end_id], "<u4").tobytes()
    full_group = GROUP_WINDOWS * max(capacity - SPARE, 1)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library = word_ids(vocabulary, cache_words)
        # What earlier stages and the reading of the vocabulary left behind.
        give_back()
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        group: list[tuple[object, int, bytes, int]] = []
        held, kind = 0, None

        def put(pieces: list[tuple[object, int, bytes, int]]) -> None:
            nonlocal sequence
            offset = 0
            for name, start, ids, tokens in pieces:
                length = len(ids) // 4
                rows.append((name, start, length, zlib.crc32(ids), tokens, sequence, offset, ids if with_ids else None))
                offset += length
            sequence += 1

        def settle() -> None:
            nonlocal group, held
            for window in windows_of([len(ids) // 4 for _, _, ids, _ in group], capacity) if group else ():
                put([group[i] for i in window])
            group, held = [], 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            rows.clear()
            types = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = library.ids(content.as_py()) + end
                tokens = len(ids) // 4
                for start in range(0, tokens - capacity + 1, capacity):
                    put([(name, start, ids[4 * start : 4 * (start + capacity)], tokens)])
                for start, length in tail_parts(tokens, capacity):
                    while length:
                        taken = min(length, full_group - held)
                        group.append((name, start, ids[4 * start : 4 * (start + taken)], tokens))
                        held, start, length = held + taken, start + taken, length - taken
                        if held == full_group:
                            settle()
                if len(rows) >= ROWS_TOGETHER:
                    yield out()
        settle()
        if rows:
            yield out()
        batch = content = None
        give_back()

    schema = PIECES.format(key=f"`{key}`", type=documents.schema[key].dataType.simpleString())
    rows = documents.select(key, F.coalesce(text, F.lit("")).alias(text))
    out = rows.mapInArrow(task, schema)
    return out if with_ids else out.drop("ids")
