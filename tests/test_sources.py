"""Readers, sinks and text expressions on hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import analytics, documents, retrieval, selection, views
from graphloom.sources import files, merge


def test_quantiles_equal_percentile(spark):
    rows = spark.range(4000).select(((F.col("id") * 7919) % 1009 / 7).alias("a"), F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 900)).cast("double").alias("b"), F.lit(2.5).alias("c"))
    values = analytics.numeric_values(rows, ["a", "b", "c"])
    shares = (0.0, 0.05, 0.5, 0.731, 0.95, 1.0)
    want = {r.column_key: r.q for r in values.groupBy("column_key").agg(F.percentile("value", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r.column_key: r.quantiles for r in analytics.column_quantiles(values, shares).collect()}
    assert got.keys() == want.keys()
    assert all(got[c] == pytest.approx(want[c]) for c in want)


def test_name_uuids_are_those_of_the_standard_library(spark):
    names = ["a", "", "1|2|3", "ünï"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.name_uuid(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_citation_checksums_tell_lines_apart(spark, tmp_path):
    line = '{"citationid":1,"citingcorpusid":2,"citedcorpusid":3,"isinfluential":true,"intents":["a"," "]}'
    (tmp_path / "c.jsonl").write_text(f"{line}\n{line}\n")
    rows = files.citation_checksums(files.numbered_lines(spark, f"file://{tmp_path}/c.jsonl")).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [0, 1] and rows[0].reference_checksum != rows[1].reference_checksum
    again = files.citation_checksums(files.numbered_lines(spark, f"file://{tmp_path}/c.jsonl")).orderBy("ordinal").collect()
    assert [r.reference_checksum for r in again] == [r.reference_checksum for r in rows]


def test_attached_rows_have_a_limit(spark):
    universe = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    stage = spark.createDataFrame([("b", 3), ("c", 4)], "id string, x int")
    assert sorted(tuple(r) for r in files.attach(universe, stage, 2).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    with pytest.raises(ValueError):
        files.attach(universe, stage, 1)


def test_spine_of_a_document_goes_in_all_tables(spark):
    rows = lambda *x: spark.createDataFrame([*x], "doc int, t string")
    found = merge.replaced_spine({"a": rows((1, "x"), (2, "y")), "b": rows((1, "p"), (2, "q"))}, {"a": rows((1, "new")), "b": rows((9, "z")).limit(0)}, "doc")
    assert sorted(tuple(r) for r in found["a"].collect()) == [(1, "new"), (2, "y")]
    assert [tuple(r) for r in found["b"].collect()] == [(2, "q")]


def test_sentences_of_a_long_block(spark):
    whole = " ".join(f"Sentence {i}!" for i in range(3000))
    blocks = spark.createDataFrame([("d", 0, 0, 5, whole)], "corpus_id string, block_ordinal int, section_ordinal int, start_offset int, text string")
    rows = documents.block_sentences(blocks).orderBy("sentence_ordinal").collect()
    assert len(rows) == 3000
    # The text has its outer spaces off; the offsets are those of the whole sentence.
    assert all(whole[r.start_offset - 5 : r.end_offset - 5].strip() == r.text == f"Sentence {r.sentence_ordinal}!" for r in rows)


def test_numbers_follow_the_whole_order(spark):
    df = spark.createDataFrame([(i * 37 % 100 // 10, i) for i in range(100)], "a int, b int")
    rows = views.numbered(df, [F.desc("a"), F.asc("b")], 1, "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in rows] == sorted(((r.a, r.b) for r in rows), key=lambda x: (-x[0], x[1])) and [r.n for r in rows] == list(range(1, 101))


def test_any_number_of_queries_meets_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PACKED", 7)
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("embedding"))
    found = retrieval.nearest(vectors, vectors.select(F.col("vec_id").alias("query_id"), "embedding"), 3).collect()
    v = {r.vec_id: r.embedding for r in vectors.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    for q in v:
        best = sorted((o for o in v if o != q), key=lambda o: (-round(dot(q, o), 12), o))[:3]
        got = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert [round(dot(q, o), 9) for o in got] == [round(dot(q, o), 9) for o in best]


def test_materialised_authors(spark):
    papers = spark.createDataFrame([("1", 1, 1, None, "V", 2000, True, None, None, "t", None), ("2", 2, 2, None, None, None, False, None, None, None, "a")], "paper_id string, corpus_id long, pmid long, source_venue_id string, venue_raw string, year int, is_open_access boolean, doi_norm string, pmc_id string, title string, abstract string")
    status = spark.createDataFrame([(1, "mapped"), (2, "corpus")], "corpus_id long, domain_status string")
    venues = spark.createDataFrame([(7, None, " v ")], "venue_id long, source_venue_id string, name string")
    written = spark.createDataFrame([("1", 0, "A", "New name"), ("1", 1, None, "Other"), ("2", 0, "B", "Not mapped")], "paper_id string, author_ordinal int, source_author_id string, name_raw string")
    authors = spark.createDataFrame([("A", "Old name")], "source_author_id string, display_name string")
    mentions = spark.createDataFrame([(1, 0, 0, 1, "x", "c", 1), (1, 0, 0, 1, "y", "c", 1), (2, 0, 0, 1, "x", "c", 1)], "pmid long, start_offset int, end_offset int, entity_type int, mention_text string, concept_id_raw string, resource int")
    relations = spark.createDataFrame([(1, 4, "s", "o", 3, 2, 1), (1, 4, "s", "o", 3, 2, 1), (1, 4, "s", "p", 3, 2, 2)], "pmid long, relation_type int, subject_entity_id string, object_entity_id string, subject_type int, object_type int, relation_source int")
    made = selection.materialised(papers, status, venues, written, authors, mentions, relations)
    assert {r.corpus_id: r.venue_id for r in made["papers"].collect()} == {1: 7, 2: None}
    assert {r.corpus_id: (r.text_availability, r.abstract_hash is None) for r in made["paper_text"].collect()} == {1: (0, True), 2: (1, False)}
    assert sorted((tuple(r) for r in made["authors"].collect()), key=repr) == sorted([("A", "New name"), (None, "Other")], key=repr)
    assert sorted((r.corpus_id, r.author_ordinal, r.display_name) for r in made["paper_authors"].collect()) == [(1, 0, "New name"), (1, 1, "Other")]
    assert [(r.corpus_id, r.mention_text) for r in made["entity_annotations"].collect()] == [(1, "y")] and made["relations"].count() == 1


def test_best_match_meets_one_known_row_for_each_value(spark):
    """Of the known rows of one value only the best goes into the join: rows are not multiplied by a value's known rows."""
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, None, None)], "id int, first string, second string")
    known = spark.createDataFrame([(9 - i, "a" if i % 3 else None, "x") for i in range(8)] + [(0, "c", "y"), (1, "c", None)], "n int, first string, second string")
    df = merge.best_match(rows, known, "id", ["first", "second"], ["n"])
    assert {(r["id"], r["matched_n"]) for r in df.collect()} == {(1, 2), (2, 2), (3, 0), (4, None)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.split("Join Inner")[1:]
    assert len(joins) == 2 and all("Aggregate [" in j for j in joins)


def test_documents_are_read_once(spark):
    """XML is parsed once for a document, not anew for each column, filter or part that reads it."""
    from graphloom.sources import xml

    text_ = '<document><id>7</id><passage><offset>0</offset><text>x</text><annotation id="a"><infon key="type">Chemical</infon><infon key="identifier">C</infon><location offset="1" length="2"/><text>w</text></annotation><annotation id="b"><infon key="type">Disease</infon><infon key="identifier">D</infon><location offset="4" length="2"/><text>w</text></annotation></passage><relation id="r"><infon key="type">Association</infon><node refid="a"/><node refid="b"/></relation></document>'
    rows = xml.parsed(spark.createDataFrame([(text_,), ("<document><id>8</id>",), (None,)], "xml string").repartition(2))
    for made, most in ((xml.entities(rows, 1), 1), (xml.relations(rows, 1), 0)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") <= most
    assert [(r.pmid, r.start_offset) for r in xml.entities(rows, 1).orderBy("start_offset").collect()] == [(7, 1), (7, 4)]
    assert [(r.pmid, r.subject_entity_id, r.object_entity_id) for r in xml.relations(rows, 1).collect()] == [(7, "C", "D")]
