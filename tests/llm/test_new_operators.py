"""Encoding and decoding, repair of conversations and hard negatives, against the library and brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import conversations as conv
from graphloom.llm import hard_negatives as hard
from graphloom.llm.bpe_codec import ByteCodec, encoded
from graphloom.llm.common import table

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, CODEC = Tokenizer.from_file(BYTES), ByteCodec(BYTES)


def library_ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("abehinort '\n\t.,1é漢\x1c", max_size=300)))
def test_ids_and_text_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == library_ids(text)
    assert CODEC.decode(ids).decode() == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=50))
def test_any_ids_decode_as_the_library(ids):
    assert CODEC.decode(np.array(ids, "<u4").tobytes()).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 200_000, " " * 100_000 + "x", "=" * 100_000, "é" * 100_000, "<|endoftext|>" * 3 + " x<|endoftext|"])
def test_long_pre_tokens_are_exact(text):
    assert CODEC.encode(text) == library_ids(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr("graphloom.llm.bpe_codec.CACHE_WORDS", 20)
    monkeypatch.setattr("graphloom.llm.bpe_codec.CACHE_PAIRS", 50)
    codec, rng = ByteCodec(BYTES), random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 90))) for _ in range(8))
        assert codec.encode(text) == library_ids(text)
        assert len(codec.young) <= 20 and len(codec.compatible) <= 50


def test_encoded_rows(make, odd_texts):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids), r.decoded) for r in encoded(make(odd_texts), BYTES).collect()}
    want = set()
    for i, t in odd_texts:
        ids = library_ids(t or "")
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids, t or ""))
    assert got == want
    assert encoded(make([]), BYTES).count() == 0


# Conversations


def brute(rows):
    """Least (cost, audit) and repaired turns, over all edits of (role, text, has to go, truncated) and up to two inserts at a place."""
    found = []

    def sound(roles):
        s = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or s != "" and len(s) % 2 == 0 and s == "ua" * (len(s) // 2)

    def go(at, cost, audit, out):
        for inserts in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")):
            c, a, o = cost + 2 * len(inserts), audit + "I" * len(inserts), out + [(r, "") for r in inserts]
            if at == len(rows):
                if sound("".join(r[:1] or "?" for r, _ in o)):
                    found.append((c, a, o))
                continue
            role, text, gone, cut = rows[at]
            go(at + 1, c + 3, a + "D", o)
            if not gone:
                go(at + 1, c + cut, a + "K", [*o, (role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, c + cut + 2, a + "R", [*o, (new, text)])

    go(0, 0, "", [])
    return min(found, key=lambda f: f[:2])


def classed(rows):
    return "".join((r[:1] if r[:1] in ("s", "u", "a") else "?") + ("x" if gone else "t" if cut else "-") for r, _, gone, cut in rows)


def test_repairs_equal_brute_force():
    rng = random.Random(4)
    for n, tries in ((0, 1), (1, 30), (2, 120), (3, 60)):
        for _ in range(tries):
            rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(n)]
            cost, audit, turns = brute(rows)
            assert conv.accepted(conv.parsed(classed(rows))) == (cost, audit)
            assert conv.edited([(r, t) for r, t, _, _ in rows], audit, "")[0] == turns


def test_parts_chain_to_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        rows = "".join(rng.choice("sua?") + rng.choice("xt--") for _ in range(rng.randint(0, 12)))
        cut = 2 * rng.randint(0, len(rows) // 2)
        ways = {}
        for middle, (c, a) in conv.parsed(rows[:cut]).items():
            for end, (d, b) in conv.parsed(rows[cut:], middle).items():
                ways[end] = min((c + d, a + b), ways.get(end, (c + d, a + b)))
        assert ways == conv.parsed(rows)


def plain_repair(rows):
    """The contract, in plain Python, for the (turn, role, text, copies) rows of one conversation, with parsing in one piece."""
    rows = [r[:3] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for _ in range(r[3])]
    seen, marked = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        letters = text.strip(" \t\n\v\f\r")
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = conv.accepted(conv.parsed(classed(marked)))
    lines, _ = conv.edited([m[:2] for m in marked], audit, "")
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(c, t, role, text):
    kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
    return None if kind == 0 else (t, "user" if kind == 4 else role, text, 2 if kind == 3 else 1)


def expected(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c] += [d] if (d := damage(c, t, role, text)) else []
    return {c: plain_repair(held) for c, held in by.items()}


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("segment", [3, 500])
def test_damaged_conversations_are_repaired(spark, monkeypatch, segment):
    monkeypatch.setattr(conv, "SEGMENT", segment)
    rng = random.Random(6)
    rows = []
    for c in [*range(60), None, 2**60 + 1]:
        for t in range(rng.randint(1, 400 if c == 7 else 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "", "tool", None])
            text = rng.choice(["Yes.", "no", " \n", "", None, "What? ", "x" * 3000 + "!", "ünï.", f"{t}?"])
            rows.append((c, rng.choice([t, t, t, t + 2, None, 2**55 + t]) if c != 5 else None, role, text))
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string").repartition(5)
    want = expected(rows)
    got = results(conv.repaired(conv.damaged(df), df))
    assert got == want
    full = conv.repaired(conv.damaged(df), df, with_turns=True).collect()
    assert all(hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.turns).encode()).hexdigest() == r.repaired_sha256 for r in full)
    assert conv.repaired(conv.damaged(df.limit(0)), df.limit(0)).count() == 0


def test_the_given_conversations(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    want = expected([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert results(conv.repaired(conv.damaged(df), df)) == want


# Hard negatives


def mined(rows, anchors, positives, negatives, low, high):
    """All by brute force, in Python's integers; rows are told apart by their place."""
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(x))) for x in v]
        if sum(x * x for x in q) <= 2**62:
            kept.append((i, label, q))
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, m, w) in enumerate(kept) if b != a and len(w) == len(v)]
        scored.sort()
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p][:negatives]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("group", [7, 32_768])
def test_negatives_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(hard, "GROUP", group)
    monkeypatch.setattr(hard, "SAMPLE", 60)
    monkeypatch.setattr(hard, "STRIPE", 5)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 10))
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in centres[rng.integers(0, 4)] + 0.5 * rng.normal(size=10)]) for i in range(300)]
    rows += [(i + 1000, r[1], r[2]) for i, r in enumerate(rows[:50])] + [(40, 1, rows[3][2]), (40, 1, rows[3][2])]  # copies, and two rows of one key
    rows += [(20, None, [1.0] * 10), (60, 1, None), (80, 2, [1.0, None, *[0.0] * 8]), (100, 2, [float("nan")] * 10), (120, 0, [1e300] * 10), (140, 0, [0.0] * 10), (None, 1, [1.0] * 10)]
    rows += [(160, 0, [1.0, 2.0]), (161, 0, [2.0, 1.0]), (162, 1, [1.0, 1.0]), (180, 1, []), (181, 1, []), (182, 2, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, uid int, content string").repartition(3)
    got = sorted(map(tuple, hard.hard_negatives(df, F.col("id") % 20 == 0, 3, 4, 30, 90).collect()))
    assert got == mined(rows, 20, 3, 4, 30, 90)
    assert hard.hard_negatives(df.limit(0), F.col("id") % 20 == 0, 3, 4, 30, 90).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    vectors = np.floor(256 * rng.normal(size=(500, 20)))
    book = hard.fit(list(vectors[:100]))
    codes, residuals = hard.coded(vectors, hard.centroids_of(book, 20))
    import pandas as pd

    group = hard.Group(pd.DataFrame({"dim": 20, "id": range(500), "uid": range(500), "content": [v.astype("<i8").tobytes() for v in vectors], "codes": [c.tobytes() for c in codes], "residuals": [r.tobytes() for r in residuals]}), book)
    lower, upper = group.bounds(vectors[:50].astype(np.int64))
    exact = vectors[:50] @ vectors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper - lower).mean() < np.abs(exact).max()
