import random
import re
import zlib
from dataclasses import replace

from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.quality_rules import Condition, judge, keep, learn, sequential_covering
from graphloom.llm.toxicity import Automaton, Lexicon, allowed, learn as learn_lexicon, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=repr)


def test_base_counts_equal_brute_force(spark, make, odd_texts, sf_dir, words):
    rng = random.Random(7)
    run = rng.choices(words, k=10)
    texts = odd_texts + [(20, " ".join(run + rng.choices(words, k=30) + run)), (21, "a\nb\na\n\n a\n#*$%&|<>\n"), (22, "x " * 60 + " y z"), (23, " ".join(run * 5))]
    assert found(judge(make(texts), [])) == sorted(((i, *counts(t)) for i, t in texts), key=repr)
    documents = table(spark, sf_dir, "documents")
    assert found(judge(documents, [])) == sorted(((r.doc_id, *counts(r.text)) for r in documents.collect()), key=repr)
    assert judge(make([]), []).count() == 0


def test_rules_are_native_and_keep_good_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = learn(documents, labels)
    judged = judge(documents, rules)
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = judged.filter(~F.col("base_failed")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    share = {r.quality: r.kept for r in rows}
    assert share[1] >= 0.97
    # Learned on one half of the labels, held against the other.
    half = learn(documents, labels.filter("doc_id % 2 = 0"))
    other = judge(documents, half).filter(~F.col("base_failed")).join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in other}
    assert kept[1] >= 0.95 and kept[0] <= 0.5
    assert keep(documents, rules).columns == documents.columns
    assert keep(documents, rules).count() == judged.filter("kept").count()


def test_covering_finds_a_conjunction(spark, make):
    cells = [({"a": a, "b": b}, held, a > 2 and b > 1, 20) for a in range(5) for b in range(4) for held in (False, True)]
    rules = sequential_covering(cells)
    assert len(rules) == 1 and sorted(rules[0]) == [("a", True, 2), ("b", True, 1)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert learn(make([(1, "a b")]), none) == []
    one = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert learn(make([(1, "a b " * 20)]), one) == []
    text = " ".join(f"w{i}" for i in range(40))
    assert [r.kept for r in judge(make([(1, text)]), [(Condition("n_words", True, 3.0),)]).collect()] == [False]


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_brute_force(words):
    """Insertions, deletions, changes and swaps, those across any place of an entry as well."""
    rng = random.Random(8)
    entries = [w for w in words if len(w) >= 5][:120]
    automaton = Automaton(entries)
    tried = [w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in entries[:60] for k in range(len(w) - 1)]
    for entry in entries:
        for _ in range(4):
            w = list(entry)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choices("abcdefghij", k=rng.randint(0, 2))
            tried.append("".join(w))
    for word in tried:
        assert automaton.nearest(word) == min(((d, e) for e in entries if 0 < (d := distance(word, e)) <= allowed(e)), default=None)


def test_automaton_starts_anew_when_it_is_full(words, monkeypatch):
    from graphloom.llm import toxicity

    entries = [w for w in words if len(w) >= 5][:60]
    tried = [w[1:] + w[0] for w in words] + [w[:-1] for w in entries]
    whole = [Automaton(entries).nearest(w) for w in tried]
    monkeypatch.setattr(toxicity, "MOST_STATES", 50)
    small = Automaton(entries)
    assert [small.nearest(w) for w in tried] == whole and any(whole)


def test_held_out_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = documents.join(labels.filter("toxic is not null").select("doc_id"), "doc_id", "left_semi")
    lexicon = learn_lexicon(documents, labels)
    found = lambda lexicon: {r.doc_id for r in score_toxicity(own, lexicon).filter("held_out and predicted = 1").join(labels.filter("toxic = 1").select("doc_id"), "doc_id").collect()}
    # Misspellings decide: without their hits, some toxic texts are not found.
    exact = replace(lexicon, weights={k: 0.0 if k[0] != "word" else w for k, w in lexicon.weights.items()}, rates={k: w for k, w in lexicon.rates.items() if k[0] == "word"})
    assert len(found(lexicon)) >= len(found(exact)) + 5
    rows = score_toxicity(own, lexicon).join(labels, "doc_id").filter("held_out").collect()
    bad = [r.score for r in rows if r.toxic == 1]
    good = [r.score for r in rows if r.toxic == 0]
    assert len(bad) > 10 and len(good) > 100
    assert sum(x >= 0.7 for x in bad) / len(bad) > 0.88
    assert sum(x >= 0.7 for x in good) / len(good) < 0.01
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_of_odd_texts(spark, make, odd_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score_toxicity(make(odd_texts), learn_lexicon(make(odd_texts), none)).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r.score < 0.7 and r.predicted == 0 for r in rows)
    lexicon = Lexicon({"frobber": (1.0, 50)}, {("word", "frobber"): 8.0, ("one edit", "frobber"): 6.0})
    texts = [(1, "you are a frobber"), (2, "you are a froober"), (3, 'he said "you frobber"'), (4, "a fine day"), (5, "you,frobber/fool"), (6, "fr0bber!")]
    s = {r.doc_id: r.score for r in score_toxicity(make(texts), lexicon).collect()}
    assert s[1] > s[2] > 0.7 > s[3] > s[4] and s[5] > 0.7 and s[6] > 0.7
