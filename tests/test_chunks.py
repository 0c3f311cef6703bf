"""Chunks by tokens: golden cases and what has to hold for any text."""

import random
import re

from pyspark.sql import functions as F

from graphloom.operators import documents as docs

COLUMNS = "corpus_id long, section_ordinal int, block_ordinal int, block_kind string, text string"


def made(spark, rows, target, most):
    found = docs.token_chunks(spark.createDataFrame(rows, COLUMNS).repartition(3), target=target, most=most)
    return [(r.corpus_id, r.section_ordinal, r.chunk_ordinal, r.first_block, r.last_block, r.tokens, r.text) for r in found.orderBy("corpus_id", "section_ordinal", "chunk_ordinal").collect()]


def test_chunks_close_at_the_target_and_captions_stay(spark):
    p, c = "narrative_paragraph", "figure_caption"
    rows = [(1, 0, 0, p, "a b c d"), (1, 0, 1, c, "e f"), (1, 0, 2, p, "g h"), (1, 0, 3, c, "i j k"), (1, 1, 4, p, "l"), (1, 1, 5, p, " .. "), (1, 1, 6, p, "  ")]
    assert made(spark, rows, 4, 6) == [
        (1, 0, 0, 0, 1, 6, "a b c d\ne f"),  # the caption joins though the target is reached
        (1, 0, 1, 2, 3, 5, "g h\ni j k"),
        (1, 1, 0, 4, 5, 3, "l\n .. "),  # sections are apart, blocks without a token go
    ]


def test_long_blocks_are_cut_at_sentences_then_between_tokens(spark):
    rows = [(2, 0, 0, "narrative_paragraph", "One two. Three four five! Six, seven eight nine ten eleven twelve")]
    assert [(t, x) for *_, t, x in made(spark, rows, 5, 6)] == [(3, "One two."), (4, "Three four five!"), (6, "Six, seven eight nine ten"), (2, " eleven twelve")]


def test_no_chunk_is_over_and_nothing_is_lost(spark):
    rng = random.Random(1)
    words = ["a", "bc", "12", "d.", "e!", "f,g", "h...", "é", "--", "漢字 "]
    rows = [(i, s, b, rng.choice(["narrative_paragraph", "table_body_text"]), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 90])))) for i in range(12) for s in range(2) for b in range(5)]
    found = made(spark, rows, 20, 30)
    bare = lambda t: re.sub(r"\s", "", t)
    for i in range(12):
        for s in range(2):
            mine = [f for f in found if f[:2] == (i, s)]
            assert all(0 < f[5] <= 30 for f in mine) and [f[2] for f in mine] == list(range(len(mine)))
            assert bare("".join(f[6] for f in mine)) == bare("".join(r[4] for r in rows if r[:2] == (i, s)))
    frame = spark.createDataFrame([(f[6], f[5]) for f in found], "text string, tokens int")
    assert frame.filter(docs.token_count(F.col("text")) != F.col("tokens")).count() == 0
