import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.common import table
from graphloom.llm.packing import differencing, pack, tail_parts, windows_of
from graphloom.llm.token_count import MergeCounter, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY, COUNTER = Tokenizer.from_file(BYTES), MergeCounter(BYTES)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_counts_as_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_token_counts(make, odd_texts):
    rows = count_tokens(make(odd_texts), BYTES, 1024).collect()
    want = sorted(((i, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_texts), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows)
    assert count_tokens(make([]), BYTES, 1024).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200), st.sampled_from([64, 256, 2048]))
def test_windows_hold_every_part_once(lengths, capacity):
    windows = windows_of(lengths, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in w) <= capacity for w in windows)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 9000), st.sampled_from([64, 256, 2048]))
def test_tails_are_cut_whole(length, capacity):
    parts = tail_parts(length, capacity)
    assert sum(n for _, n in parts) == length % capacity
    at = length - length % capacity
    for start, n in parts:
        assert start == at and 0 < n <= 512
        at += n


def test_differencing_is_near_equal_and_windows_rise():
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in rng.integers(1, 900, 200)]
    sums = [sum(lengths[i] for i in w) for w in differencing(lengths, 20)]
    assert max(sums) - min(sums) <= 30
    # Seven of these would do by their sum, but no two fit one window.
    assert len(windows_of([700] * 9, 1000)) == 9


def test_little_is_padding(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents").coalesce(1)
    sums = [r.n for r in pack(documents, WORDS, 2048, 1, with_ids=False).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    read = sum(n if n & (n - 1) == 0 else 2048 for n in sums)
    assert max(sums) <= 2048 and read - sum(sums) < 0.02 * read


def test_pieces_are_the_ids(make, odd_texts, spark):
    library = Tokenizer.from_file(WORDS)
    pairs = [(i, t) for i, t in odd_texts if i != 10] + [(11, "Many Words " * 4000), (2**60 + 1, "large id"), (-(2**62) - 1, "x")]
    rows = pack(make(pairs), WORDS, 2048, 1).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in pairs:
        own = sorted(by_doc[i], key=lambda r: r.start)
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
        assert {r.doc_tokens for r in own} == {len(ids)}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    repeated = pack(make([(10, "same id"), (10, "other text"), (None, "a"), (None, "a")]), WORDS, 2048, 1).collect()
    assert sorted(((r.doc_id, bytes(r.ids)) for r in repeated), key=repr) == sorted(((i, np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in [(10, "same id"), (10, "other text"), (None, "a"), (None, "a")]), key=repr)
    assert pack(make([]), WORDS, 2048, 1).count() == 0


def test_what_is_freed_goes_back_to_the_system():
    """In a process of its own: of 200 MB of freed Arrow strings less than a half stays."""
    import subprocess
    import sys

    code = """
import re
import pyarrow as pa
from graphloom.llm.common import give_back
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
give_back()
before = held()
texts = [pa.array(["x" * 1000] * 1000) for _ in range(200)]
peak = held()
del texts
give_back()
print(before, peak, held())
"""
    before, peak, after = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert peak - before > 150
    assert after - before < (peak - before) / 2


def test_a_worker_reads_the_vocabulary_once(make, monkeypatch):
    """Each task of a worker gets its function unpickled anew; what it reads must not come with it."""
    import pyarrow as pa
    from pyspark import TaskContext, cloudpickle

    from graphloom.llm import packing

    docs, sent, read, first = make([(1, "a text")]), [], [], packing.WordIds.__init__
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: sent.append(cloudpickle.dumps(task)) or self)
    pack(docs, WORDS, 2048, 1, cache_words=1234)
    monkeypatch.setattr(packing.WordIds, "__init__", lambda self, *given: read.append(given) or first(self, *given))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Context", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a text"])], ["doc_id", "text"])
    for _ in range(3):
        assert sum(b.num_rows for b in cloudpickle.loads(sent[0])(iter([batch]))) == 1
    assert read == [(WORDS, 1234)]
