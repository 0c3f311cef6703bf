import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm.near_dedup import inverse_frequencies, near_duplicates, similarity, weighted_samples, weighted_shingles, without_near_duplicates
from graphloom.llm.suffix_dedup import LENGTH, repeated_starts, transform, without_repeats


def changed(words, text, n, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(words)
    return " ".join(w)


def test_samples_agree_as_often_as_sets_are_similar(words):
    rng = random.Random(1)
    idf = np.linspace(1, 2, 1 << 18).astype(np.float32)
    text = " ".join(rng.choices(words, k=400))
    agree, like = [], []
    for seed in range(12):
        other = changed(words, text, 8, random.Random(seed))
        a, b = weighted_shingles(text, idf), weighted_shingles(other, idf)
        like.append(similarity(a, b))
        agree.append(np.mean([x == y for x, y in zip(weighted_samples(*a), weighted_samples(*b))]))
    assert abs(np.mean(agree) - np.mean(like)) < 0.08


def test_classes_equal_brute_force(make, words, odd_texts):
    rng = random.Random(2)
    base = [" ".join(rng.choices(words, k=rng.randint(60, 300))) for _ in range(25)]
    texts = [*base]
    for b in base[:12]:
        texts += [b, changed(words, b, 1, rng), changed(words, b, 2, rng), changed(words, b, len(b.split()) // 8, rng)]
    pairs = [(100 + i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in odd_texts if i not in (None, 10)]
    documents = make(pairs)
    idf = inverse_frequencies(documents, "text")
    sets = {i: weighted_shingles(t or "", idf) for i, t in pairs}
    label = {i: i for i, _ in pairs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, t), (j, u) in itertools.combinations(pairs, 2):
        same = (t or "") == (u or "") if not len(sets[i][0]) or not len(sets[j][0]) else similarity(sets[i], sets[j]) >= 0.8
        if same:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    found = {r.doc_id: r.class_id for r in near_duplicates(documents).collect()}
    assert found == {i: root(i) for i, _ in pairs}


def test_links_in_large_mixed_buckets_are_found(make, words):
    rng = random.Random(8)
    template = rng.choices(words, k=150)
    texts = []
    for _ in range(130):
        own = template + rng.choices(words, k=30)
        near = list(own)
        for at in rng.sample(range(0, 150, 8), 3):
            near[at] = rng.choice(words)
        texts += [" ".join(own), " ".join(near)]
    documents = make(enumerate(texts))
    idf = inverse_frequencies(documents, "text")
    sets = [weighted_shingles(t, idf) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(label[:], 2):
        if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert 100 < len(set(label)) < 200
    found = {r.doc_id: r.class_id for r in near_duplicates(documents).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_classes_of_rows_without_id_and_of_no_rows(make, odd_texts):
    rows = near_duplicates(make(odd_texts)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_texts)
    assert near_duplicates(make([])).count() == 0


def brute(pairs):
    contents = [(t or "").encode() for _, t in pairs]
    seen = Counter(c[i : i + LENGTH] for c in contents for i in range(len(c) - LENGTH + 1))
    out = []
    for (name, _), c in zip(pairs, contents):
        covered = bytearray(len(c))
        for i in range(len(c) - LENGTH + 1):
            if seen[c[i : i + LENGTH]] > 1:
                covered[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, x in zip(c, covered) if not x)
        spans = sum(x and not (i and covered[i - 1]) for i, x in enumerate(covered))
        out.append((name, len(c), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)


def test_removed_bytes_equal_brute_force(make, words):
    rng = random.Random(3)
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    fresh = lambda n: " ".join(rng.choices(words, k=n))
    pairs = [(i, fresh(30) + passages[i % 4] + fresh(20) + (passages[(i + 1) % 4] if i % 3 == 0 else "")) for i in range(24)]
    pairs += [(100, None), (101, ""), (102, "a" * 700), (103, "abcabc" * 100), (104, "漢字" * 90 + fresh(10)), (105, "漢字" * 90), (106, "b" * 199), (107, "c" * 200), (108, pairs[5][1]), (108, pairs[5][1])]
    assert digest(without_repeats(make(pairs)).collect()) == brute(pairs)
    clean = [(i, fresh(80)) for i in range(5)]
    assert all(r.n_removed == 0 and r.kept_text == t for r, (_, t) in zip(sorted(without_repeats(make(clean)).collect(), key=lambda r: r.doc_id), clean))
    assert without_repeats(make([])).count() == 0


def test_anchor_of_very_many_contexts_is_counted_whole(make, words, monkeypatch):
    from graphloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 5)
    rng = random.Random(4)
    passage = " ".join(rng.choices(words, k=50))
    pairs = [(i, " ".join(rng.choices(words, k=20)) + passage + " ".join(rng.choices(words, k=20))) for i in range(15)]
    assert digest(without_repeats(make(pairs)).collect()) == brute(pairs)


def test_merged_transforms_equal_counting():
    rng = random.Random(6)
    contexts, groups, before = [], [], []
    core = bytes(rng.choices(b"abcd", k=220))
    for i in range(30):
        contexts.append(bytes(rng.choices(b"ab", k=20)) + core[: rng.randint(150, 220)] + bytes(rng.choices(b"ab", k=60)))
        groups.append(i // 10)
        before.append(100)
    found = repeated_starts(np.array(groups), contexts, np.array(before), np.array([rng.randrange(4) for _ in contexts]))
    counts = defaultdict(Counter)
    for g, c in zip(groups, contexts):
        counts[g].update({c[i : i + LENGTH] for i in range(len(c) - LENGTH + 1)})
    for g, c, flags in zip(groups, contexts, found):
        # Equal strings of a group stand at equal distances from the anchor.
        assert [counts[g][c[i : i + LENGTH]] > 1 for i in range(len(flags))] == flags.tolist()


def test_shards_are_transforms_that_merge():
    """A shard's columns are the symbols before its sorted suffixes; one shard alone gives what several give."""
    rng = random.Random(9)
    contexts = [bytes(rng.choices(b"ab", k=368)) for _ in range(12)]
    table = np.array([list(c) for c in contexts], np.uint16)
    symbols, _ = transform(np.zeros(len(contexts), np.int64), np.ascontiguousarray(table.T))
    for column in (367, 200, 1):
        order = sorted(range(len(contexts)), key=lambda i: contexts[i][column + 1 :])
        assert symbols[column].tolist() == [contexts[i][column] for i in order]


def test_anchors_of_stretches_are_those_of_the_whole(monkeypatch):
    from graphloom.llm import suffix_dedup

    content = bytes(random.Random(10).choices(b"abcdefgh ", k=5000))
    covered = lambda found: {(k, p, i) for k, p, first, last in zip(*map(list, found), strict=True) for i in range(first, last + 1)}
    whole = covered(suffix_dedup.anchors(content))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    assert covered(suffix_dedup.anchors(content)) == whole


def test_rows_of_one_id_and_unlike_texts_keep_their_classes(make, words):
    rng = random.Random(11)
    a, b, c = (" ".join(rng.choices(words, k=90)) for _ in range(3))
    near = changed(words, a, 1, rng)
    rows = near_duplicates(make([(1, a), (1, b), (2, near), (3, b), (4, c), (None, c), (None, "no other"), (2**60 + 1, near)])).collect()
    assert sorted(((r.doc_id, r.class_id) for r in rows), key=repr) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (None, None), (2**60 + 1, 1)], key=repr)
    kept = without_near_duplicates(make([(1, a), (1, b), (1, b), (2, near), (3, b), (None, c), (5, c), (None, "no other"), (None, "no other")])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (1, b), (5, c), (None, "no other")], key=repr)


def test_texts_without_partner_go_before_their_pairs_are_met(make, words):
    """A large group whose texts differ by many words of their own, and a few that differ by one: equal to brute force."""
    rng = random.Random(12)
    base = " ".join(rng.choices(words, k=150))
    texts = [changed(words, base, rng.choice([0, 1, 2, 3, 4, 6, 9]), rng) for _ in range(160)]
    documents = make(enumerate(texts))
    idf = inverse_frequencies(documents, "text")
    sets = [weighted_shingles(t, idf) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(label[:], 2):
        if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert len(set(label)) > 20
    found = {r.doc_id: r.class_id for r in near_duplicates(documents).collect()}
    assert [found[i] for i in range(len(texts))] == label
