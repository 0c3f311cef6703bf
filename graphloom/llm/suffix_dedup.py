"""Removal of passages that are repeated anywhere, by merging shards' Burrows-Wheeler transforms.

A full merge of the shards' transforms passes over every byte as often as the longest repeat is long. So
the suffixes are cut down first, without loss: of every 200-byte string the k-gram of smallest hash is
its anchor; equal strings have equal anchors at equal places, and an anchor that occurs once can hold no
repeat. What is left are the contexts of shared anchors, and only suffixes that start at the same
distance from the same anchor have to be told apart.

Documents are dealt to shards by a hash. For each shard, the contexts of every anchor get their
Burrows-Wheeler transform, column by column: the symbols before the suffixes, in the order of the
suffixes. The shards' transforms are then merged by refining an interleave, which says from which shard
the next suffix comes: at first by shard, then each step reads the symbols off the transforms in its
order and deals the interleave out by symbol, keeping order within a symbol. The common prefix of
neighbours grows by one, or is one more than the least between them, so suffixes of different shards
are never compared nor sorted again. Intervals whose common prefix reaches 200 are repeats.

An anchor with very many different contexts is not left to one task: its contexts are halved by
where their strings start, and each half is grouped anew by the anchor and the bytes that all its
strings share. Halves that no other shares go, equal ones are one; what is still crowded is halved
again, down to single strings. So a context makes two rows for each halving and not one for each
string, and the result is the same.

Strings are UTF-8 bytes and never cross documents. Null texts are empty; texts of fewer than 200
bytes keep everything. Rows are told apart by key and text; repeated rows, with or without a key, make
each other's strings repeats. No ties arise: every copy goes. All other columns are kept as they are,
whatever their names. A very long text is held by one task and cut into stretches for its anchors.
Nothing is capped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, require, stored, text_or_empty

LENGTH, GRAM = 200, 32
#: K-grams that start in one string, and the widest context to the left of an anchor.
STARTS = LENGTH - GRAM + 1
#: Different contexts of an anchor up to which they are refined together, and contexts in a batch.
MOST_CONTEXTS, BATCH = 2_000, 4_000
#: Texts whose anchors and contexts are handed on together.
TOGETHER = 500
#: Document keys up to which they are broadcast (16 bytes each); more are joined by a shuffle.
MOST_KEYS = 500_000

#: Into how many shards documents are dealt.
SHARDS = 4
#: Bytes of a text whose anchors are found together; places within them take so many bits beside the hash.
STRETCH, _PLACE = 1 << 20, 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOLS = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def _powers(base: int, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    have = known.get(base)
    if have is None or len(have) < size:
        with np.errstate(over="ignore"):
            have = known[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(size, 1 << 16) - 1, base, np.uint64)]))
    return have[:size]


_KNOWN: dict[int, np.ndarray] = {}


def anchors(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, places, and the first and last start of the strings that each anchor stands for."""
    n = len(content)
    if n > STRETCH + LENGTH:
        # Stretches overlap so that each string lies in one of them.
        parts = [(at, anchors(content[at : at + STRETCH + LENGTH - 1])) for at in range(0, n - LENGTH + 1, STRETCH)]
        keys, *others = (np.concatenate([found[k] if k == 0 else found[k] + at for at, found in parts]) for k in range(4))
        return keys, *others
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    codes = _SYMBOLS[np.frombuffer(content, np.uint8)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, n, _KNOWN))])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _powers(_INVERSE, n - GRAM + 1, _KNOWN)
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    place = np.uint64((1 << _PLACE) - 1)
    order = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    # Least of every STARTS neighbours: from the end of one block and the beginning of the next.
    blocks = -(-len(order) // STARTS)
    padded = np.full(blocks * STARTS, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    square = padded.reshape(blocks, STARTS)
    forward = np.minimum.accumulate(square, 1).ravel()
    backward = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    least = np.minimum(backward[:starts], forward[STARTS - 1 : STARTS - 1 + starts])
    at = (least & place).astype(np.int64)
    change = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([np.zeros(1, np.int64), change])
    last = np.concatenate([change - 1, np.array([starts - 1])])
    places = at[first]
    return grams[places].view(np.int64), places, first, last


def refined(group: np.ndarray, symbols: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How one step deals an order out by the symbols before it, and the common prefixes (with the one before) afterwards."""
    rank = group + symbols
    dealt = np.argsort(rank, kind="stable")
    rank = rank[dealt]
    same = np.flatnonzero(rank[1:] == rank[:-1]) + 1
    new = np.zeros(len(rank) + 1, np.int32)
    if len(same):
        bounds = np.empty(2 * len(same), np.int64)
        bounds[0::2], bounds[1::2] = dealt[same - 1] + 1, dealt[same] + 1
        # Before any symbol is read, all suffixes of a group agree in nothing: 0 + 1.
        new[same] = np.minimum.reduceat(common, bounds)[0::2] + 1
    return dealt, new


def transform(group: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform: per column, the symbols before its suffixes in their order, and whose suffixes these then are.

    ``table`` has one row of symbols for each column; ``group`` is ascending.
    """
    width, m = table.shape
    symbols, owners = np.empty((width, m), np.uint16), np.empty((width, m), np.int32)
    order = np.arange(m)
    for column in range(width - 1, -1, -1):
        symbols[column] = table[column][order]
        order = order[np.argsort(group + symbols[column], kind="stable")]
        owners[column] = order
    return symbols, owners


def repeated_starts(groups: np.ndarray, contexts: list[bytes], before: np.ndarray, shards: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its strings equals one of another context of its group.

    ``groups`` is ascending, ``before`` counts the bytes of a context before its anchor.
    """
    m, width = len(contexts), STARTS - 1 + LENGTH
    table = np.full((m, width), 256, np.uint16)
    for i, (c, b) in enumerate(zip(contexts, before, strict=True)):
        table[i, STARTS - 1 - b : STARTS - 1 - b + len(c)] = np.frombuffer(c, np.uint8)
    table = table.T
    _, group = np.unique(groups, return_inverse=True)
    group = group.astype(np.int64) << 9
    members = [np.flatnonzero(shards == s) for s in np.unique(shards)]
    transforms = [transform(group[own], np.ascontiguousarray(table[:, own])) for own in members]
    # The interleave: from which shard the next suffix of the merged order is.
    interleave = np.empty(m, np.int8)
    for number, own in enumerate(members):
        interleave[own] = number
    interleave = interleave[np.lexsort((interleave, group))]
    repeats = np.zeros((STARTS, m), bool)
    common = np.zeros(m + 1, np.int32)
    symbol, owner = np.empty(m, np.uint16), np.empty(m, np.int64)
    for column in range(width - 1, -1, -1):
        for number, (symbols, _) in enumerate(transforms):
            symbol[interleave == number] = symbols[column]
        dealt, common = refined(group, symbol, common)
        interleave = interleave[dealt]
        if column < STARTS:
            twin = common[:m] >= LENGTH
            twin[:-1] |= common[1:m] >= LENGTH
            if twin.any():
                for number, (own, (_, owners)) in enumerate(zip(members, transforms, strict=True)):
                    owner[interleave == number] = own[owners[column]]
                repeats[column, owner[twin]] = True
    return [repeats[STARTS - 1 - b : STARTS - 1 - b + len(c) - LENGTH + 1, i] for i, (c, b) in enumerate(zip(contexts, before, strict=True))]


def runs(flags: np.ndarray) -> list[int]:
    """Beginning and end of each stretch of bytes that flagged strings cover, one after the other."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > LENGTH)
    firsts, lasts = np.concatenate([at[:1], at[gap + 1]]), np.concatenate([at[gap], at[-1:]]) + LENGTH
    return np.stack([firsts, lasts], 1).ravel().tolist()


def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut to ``TOGETHER`` rows: what is made of a text is larger than the text."""
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            yield batch[at : at + TOGETHER]


def _row_key(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(key, text_or_empty(text)).alias("uid")]


def _only(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` on doc and uid; ``keys`` is broadcast where its size allows."""
    keys = keys.select("doc", "uid").distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, ["doc", "uid"], how)


def repeated_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, uid (the row's key) and the removed stretches of its bytes, for rows that have any."""
    rows = documents.select(*_row_key(key, text), text_or_empty(text).cast("binary").alias("content"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            parts = [(d, u, *anchors(c)) for d, u, c in zip(batch["doc"], batch["uid"], batch["content"], strict=True)]
            sizes = [len(p[2]) for p in parts]
            columns = {name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(("anchor", "place", "first", "last"), 2)}
            yield pd.DataFrame({"doc": np.repeat([p[0] for p in parts], sizes), "uid": np.repeat([p[1] for p in parts], sizes), **columns})

    places = stored(rows.filter(F.octet_length("content") >= LENGTH).mapInPandas(found, "doc long, uid long, anchor long, place int, first int, last int"), "anchors", few=True)
    # Written first, so that both sides of the join are plain exchanges, which Spark can split where an anchor is hot.
    shared = stored(places.groupBy("anchor").count().filter("count > 1").select("anchor"), "shared-keys", few=True)
    kept = stored(places.join(shared, "anchor").groupBy("doc", "uid").agg(F.collect_list(F.struct("anchor", "place", "first", "last")).alias("anchors")), "shared-anchors", few=True)
    discard(places, shared)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            out = []
            for d, u, content, own in zip(batch["doc"], batch["uid"], batch["content"], batch["anchors"], strict=True):
                for a in own:
                    context = content[a["first"] : a["last"] + LENGTH]
                    before = a["place"] - a["first"]
                    name = xxhash.xxh3_128_digest(context + before.to_bytes(2, "little"))
                    out.append((d, u, a["first"], a["anchor"], name, before, context))
            yield pd.DataFrame(out, columns=["doc", "uid", "first", "anchor", "name", "before", "context"])

    affected = _only(rows, kept, "left_semi")
    cut = affected.join(kept, ["doc", "uid"]).mapInPandas(contexts, "doc long, uid long, first int, anchor long, name binary, before int, context binary")
    cut = stored(cut, "contexts", few=True)
    shard = F.pmod(F.xxhash64("doc", "uid"), F.lit(SHARDS)).cast("int").alias("shard")
    own = cut.select("anchor", "name", "before", "context", F.lit(0).alias("x"), F.lit(STARTS - 1).alias("y"), shard)
    all_spans, written = spans_of(own)
    back = cut.select("doc", "uid", "first", "name").join(all_spans, "name").select("doc", "uid", F.transform("spans", lambda x: x + F.col("first")).alias("spans"))
    done = stored(back.groupBy("doc", "uid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans", few=True)
    discard(kept, cut, *written)
    return done


_SPANS = "name binary, spans array<int>"


def spans_of(contexts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """name, spans of the contexts (anchor, name, before, context, x, y, shard) that hold repeats, and what was written.

    Strings of a context start between ``x`` and ``y`` bytes before its anchor.
    """
    distinct = stored(contexts.groupBy("anchor", "name").agg(*(F.first(c).alias(c) for c in ("before", "context", "x", "y", "shard")), F.count("*").alias("times")), "distinct-contexts", few=True)
    sizes = stored(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "anchor-sizes", few=True)
    written = [distinct, sizes]
    # A context that occurs twice is a repeat throughout; it still has to meet the others.
    whole = distinct.filter("times > 1").select("name", F.array(F.lit(0), F.octet_length("context")).alias("spans"))
    sized = distinct.join(sizes, "anchor")
    few = sized.filter(F.col("contexts") <= MOST_CONTEXTS)
    by_merge = few.select("anchor", "name", "before", "context", "shard").repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_refined, _SPANS)
    spans = by_merge.filter(F.size("spans") > 0).union(whole)
    if sizes.filter(F.col("contexts") > MOST_CONTEXTS).limit(1).count():
        crowded = sized.filter(F.col("contexts") > MOST_CONTEXTS).select("name", "anchor", "before", "context", "x", "y", "shard")
        parts = stored(crowded.mapInPandas(_halved, "parent binary, shift int, anchor long, name binary, before int, context binary, x int, y int, shard int"), "halved-contexts", few=True)
        inner, more = spans_of(parts.drop("parent", "shift"))
        found = parts.select("parent", "shift", "name").join(inner, "name")
        spans = spans.union(found.select(F.col("parent").alias("name"), F.transform("spans", lambda x: x + F.col("shift")).alias("spans")))
        written += [parts, *more]
    return spans, written


def _refined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges the contexts of whole anchors, about ``BATCH`` contexts at a time."""

    def out(held: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_starts(held["anchor"].to_numpy(), list(held["context"]), held["before"].to_numpy(), held["shard"].to_numpy())
        return pd.DataFrame({"name": held["name"], "spans": [runs(f) for f in flags]})

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        while len(held) > BATCH:
            at = int(np.searchsorted(held["anchor"].to_numpy(), held["anchor"].iloc[BATCH]))
            if not at:
                break
            yield out(held[:at])
            held = held[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield out(held)


def halves(context: bytes, before: int, x: int, y: int) -> Iterator[tuple[int, bytes, int, bytes, int, int]]:
    """shift, common bytes, before, content, x, y of either half of a context that has strings.

    Halves are of the starts ``x``..``y`` before the anchor, the same for every context.
    """
    for low, high in ((x, (x + y) // 2), ((x + y) // 2 + 1, y)):
        # A context near an edge of its document lacks some of the starts.
        first, last = max(low, before + LENGTH - len(context)), min(high, before)
        if first <= last:
            yield before - last, context[before - low : before - high + LENGTH], last, context[before - last : before - first + LENGTH], low, high


def _halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sliced(batches):
        out = []
        for name, anchor, before, context, x, y, shard in batch[["name", "anchor", "before", "context", "x", "y", "shard"]].itertuples(index=False):
            for shift, common, own, content, low, high in halves(context, before, x, y):
                place = anchor.to_bytes(8, "little", signed=True) + bytes([low, high])
                group = xxhash.xxh3_64_intdigest(place + common) - (1 << 63)
                # Contents are compared whole within a group, so two groups that share a hash do no harm.
                out.append((name, shift, group, xxhash.xxh3_128_digest(place + bytes([own]) + content), own, content, low, high, shard))
        yield pd.DataFrame(out, columns=["parent", "shift", "anchor", "name", "before", "context", "x", "y", "shard"])


def united(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal stretches of what (begin, end) pairs cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(zip(spans[0::2], spans[1::2], strict=True)):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def removal(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns as a struct), n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_text.

    ``kept_text`` drops a character that a removed stretch cuts in two.
    """
    require(documents, (key, text))
    spans = repeated_spans(documents, key, text)
    # The row key goes beside the row's own columns, whose names may be anything.
    keyed = documents.select(F.struct(*documents.columns).alias("row"), *_row_key(key, text), text_or_empty(text).cast("binary").alias("_content"))

    # One function for all, so that a task has one worker.
    @F.pandas_udf("struct<n_removed: long, n_spans: long, kept: binary, kept_text: string>")
    def removed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, stretches in batches:
            out = []
            for content, own in zip(contents, stretches, strict=True):
                at, parts = 0, []
                found = united(list(own))
                for begin, end in found:
                    parts.append(content[at:begin])
                    at = end
                left = b"".join([*parts, content[at:]])
                out.append((sum(e - b for b, e in found), len(found), left, left.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept", "kept_text"])

    n_bytes = F.octet_length("_content").cast("long").alias("n_bytes")
    # Else a filter on what it returns (as of the pipeline) would run it once more, in a worker beside the first.
    removed = removed.asNondeterministic()
    untouched = _only(keyed, spans, "left_anti").select("row", n_bytes, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_content").alias("kept"), F.col("_content").cast("string").alias("kept_text"))
    changed = _only(keyed, spans, "left_semi").join(spans, ["doc", "uid"]).withColumn("_r", removed("_content", "spans"))
    return untouched.union(changed.select("row", n_bytes, "_r.n_removed", "_r.n_spans", "_r.kept", "_r.kept_text"))


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns beside those of ``removal``, which take the place of columns of the same name."""
    found = removal(documents, key, text)
    return found.select(*(F.col("row")[c].alias(c) for c in documents.columns if c not in found.columns), *found.columns[1:])
