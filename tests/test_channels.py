"""Channels with citations, and names found by automata, against plain Python."""

import random
import re

import pytest

from graphloom.operators import channels, retrieval


def test_citations_only_lift_what_was_recalled(spark):
    rows = lambda *r: spark.createDataFrame(r, "query_id long, id long, score double")
    lanes = {"lexical": rows((1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0), (2, 10, 1.0)), "dense_query": rows((1, 12, 5.0), (1, 13, 4.0), (1, 13, 4.0))}
    cites = spark.createDataFrame([(10, 13), (99, 10), (10, 10), (13, 12)], "citing long, cited long")
    got = {(r.query_id, r.id): r for r in channels.search(lanes, cites, 10, frontier=1).collect()}
    assert set(got) == {(1, 10), (1, 11), (1, 12), (1, 13), (2, 10)}  # 99 was not recalled
    assert got[1, 12].trace == "dense_query:1 lexical:3 " .strip()
    assert got[1, 13].trace == "dense_query:2 citation_context"  # cites 12, which alone is in the frontier
    assert got[1, 13].score == round(round(1 / 62, 9) + 0.5 / 61, 9) and got[1, 10].score == round(1 / 61, 9)
    assert [r for (q, r) in sorted(got) if q == 1 and got[q, r]["rank"] == 1] == [12]
    with pytest.raises(ValueError):
        channels.rankings({"rumour": lanes["lexical"]})


def plain_mentions(texts, terms):
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    out = {}
    for key, text in texts:
        words = split(text)
        for entity, term in terms:
            t = split(term)
            places = [i for i in range(len(words)) if t and words[i : i + len(t)] == t]
            if places:
                out[key, entity] = min(places[0], out.get((key, entity), len(words)))
    return out


@pytest.mark.parametrize("limit", [3, 200_000])
def test_names_are_found_as_whole_words(spark, monkeypatch, limit):
    monkeypatch.setattr(retrieval, "TERMS", limit)
    rng = random.Random(2)
    vocabulary = ["a", "b", "ab", "aba", "é", "漢字", "x1"]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(80)] + [(100, None), (101, ""), (102, "A B, ab A b")]
    terms = [(f"e{i % 12}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 3)))) for i in range(30)] + [("e1", ""), ("e2", None), ("e3", "A-B")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    dictionary = spark.createDataFrame([(e, "k", t) for e, t in terms], "entity_id string, entity_type string, matched_text string")
    got = {(r.doc_id, r.entity_id): r["at"] for r in retrieval.mentions(df, dictionary).collect()}
    assert got == plain_mentions(texts, terms)


def test_channels_are_ranked_once(spark):
    """What recalls is ranked and kept once; the search that follows does not read the channels again."""
    lane = spark.range(20).selectExpr("1L as query_id", "id", "cast(id as double) as score")
    cites = spark.createDataFrame([(19, 18), (3, 2)], "citing long, cited long")
    found = channels.search({"lexical": lane}, cites, 3)
    assert "Range (0, 20" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in found.orderBy("rank").collect()][0] in (18, 19)
