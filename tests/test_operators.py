"""Golden cases and small cases that the given tables do not hold."""

import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom.functions import codes, text
from graphloom.operators import analytics, documents, guard, insights, overlay, scope, selection, views
from graphloom.sources import files, merge, xml


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, bare", [(" The Lancet: Neurology (London). ", "lancet"), ("Nature.", "nature"), ("Nature..", "nature."), ("", None), ("  ", None), (None, None), ("The  New (x)", "new"), ("Brain\nResearch: a\nb", "brain\nresearch")]
)
def test_clean_venue(spark, raw, bare):
    assert one(spark, text.clean_venue(F.col("v")), v=raw) == bare


def test_inventory_names_lose_all_stops(spark):
    assert one(spark, text.clean_inventory_name(F.col("v")), v="\tNature..") == "nature"
    inventory = spark.createDataFrame([("The Lancet.", "Lancet"), ("AB", None), ("Brain (Oxf)", "Brain")], "title string, medline_abbr string")
    assert sorted(r[0] for r in files.journal_names(inventory).collect()) == ["brain", "lancet"]


@pytest.mark.parametrize("raw, kind", [("MESH:D1", 2), ("NCBIGene:1", 1), ("x", 3), ("cell-line|x", 6), ("gene|MESH:D1", 1), ("odd|MESH:D1", 2), ("odd|NCBIGene:2", 1)])
def test_entity_types(spark, raw, kind):
    assert one(spark, codes.entity_type_of(F.col("v")), v=raw) == kind


def test_coercions(spark):
    assert one(spark, text.whole_number(F.col("v")), v=" 12x") is None and one(spark, text.whole_number(F.col("v")), v=" 12 ") == 12
    assert str(one(spark, text.iso_date(F.col("v")), v="2020-01-05T00")) == "2020-01-05" and one(spark, text.iso_date(F.col("v")), v="soon") is None
    assert one(spark, text.pmc_identifier(F.col("v")), v="12") == "PMC12" and one(spark, text.pmc_identifier(F.col("v")), v="pmcx") is None


def test_sentence_offsets_over_gaps(spark):
    for t in ["One. Two!! Three", "...", "", "  ", "A... b? c", "no mark", "?!a"]:
        import re

        want = [(10 + m.start(), 10 + m.end()) for m in re.finditer(r"[^.!?]+[.!?]?", t) if m[0].strip()] or ([(10, 10 + len(t))] if t.strip() else [])
        found = one(spark, documents.sentence_spans(F.col("v"), F.lit(10)), v=t)
        assert [(s.start, s.end) for s in found] == want, t


def test_annotated_document(spark):
    body = "Early words. 1 Introduction Here it starts. So it does. 1.1 Methods Then we did. Odd"
    at = lambda s: (body.index(s), body.index(s) + len(s))
    spans = lambda *xs: json.dumps([{"start": a, "end": b, **({"attributes": {"n": n}} if n else {})} for (a, b), n in xs])
    raw = spark.createDataFrame(
        [(7, (body, (spans((at("Introduction"), "1"), (at("Methods"), "1.1")), spans((at("Early words."), None), (at("Here it starts. So it does."), None), (at("Then we did. Odd"), None)), spans((at("Here it starts."), None), (at("So it does."), None)))))],
        "corpusid long, body struct<text:string, annotations:struct<section_header:string, paragraph:string, sentence:string>>",
    )
    found = documents.structured(documents.annotated(raw))
    sections = [(s.section_ordinal, s.parent_section_ordinal, s.section_role, s.display_label) for s in documents.spine(found, "sections").collect()]
    assert sections == [(0, None, "other", "Preamble"), (1, None, "introduction", "Introduction"), (2, 1, "methods", "Methods")]
    blocks = [(b.block_ordinal, b.section_ordinal, b.section_role, b.text) for b in documents.spine(found, "blocks").collect()]
    assert blocks == [(0, 0, "other", "Early words."), (1, 1, "introduction", "Here it starts. So it does."), (2, 2, "methods", "Then we did. Odd")]
    assert [(x.block_ordinal, x.sentence_ordinal, x.text) for x in documents.spine(found, "sentences").collect()] == [(0, 0, "Early words."), (1, 0, "Here it starts."), (1, 1, "So it does."), (2, 0, "Then we did."), (2, 1, "Odd")]
    assert found.first()["text_hash"] == hashlib.sha1("\n".join(b[3] for b in blocks).encode()).hexdigest()[:32]


BIOC = """<collection><document><id>5</id>
<passage><infon key="type">front</infon><offset>0</offset><text>Title</text></passage>
<passage><infon key="type">abstract</infon><infon key="section_type">ABSTRACT</infon><offset>10</offset><text> Short. Text </text></passage>
<passage><infon key="type">title_1</infon><infon key="section_type">INTRO</infon><offset>30</offset><text>Background</text></passage>
<passage><infon key="type">title_1</infon><infon key="section_type">INTRO</infon><offset>40</offset><text>Effects of</text></passage>
<passage><infon key="type">paragraph</infon><infon key="section_type">INTRO</infon><offset>50</offset><text>We start.</text></passage>
<passage><infon key="type">paragraph</infon><infon key="section_type">REF</infon><offset>60</offset><text>Cited.</text></passage></document></collection>"""


def test_bioc_blocks(spark):
    rows = spark.createDataFrame([("5", BIOC), ("6", "<broken"), ("7", None)], "corpus_id string, xml string")
    blocks = documents.bioc_blocks(documents.passages(rows)).orderBy("block_ordinal")
    assert [(b.block_ordinal, b.section_ordinal, b.display_label, b.section_role, b.is_retrieval_default, b.start_offset, b.text) for b in blocks.collect()] == [
        (0, 1, "Abstract", "abstract", True, 11, "Short. Text"), (1, 2, "Background", "introduction", True, 50, "We start."), (2, 2, "Background", "introduction", False, 60, "Cited."),
    ]
    assert documents.block_sentences(blocks).count() == 4
    assert documents.chunks(blocks.withColumn("corpus_id", F.lit("5"))).count() == 2


ANNOTATED = """<document><id>9</id><passage><infon key="type">title</infon><offset>0</offset><text>x</text>
<annotation id="a"><infon key="type">Chemical</infon><infon key="identifier">MESH:C1</infon><location offset="0" length="4"/><location offset="0" length="4"/><text>drug</text></annotation>
<annotation id="b"><infon key="type">Disease</infon><infon key="identifier">MESH:D1</infon><location offset="6" length="3"/><text>ill</text></annotation>
<annotation id="c"><infon key="type">Odd</infon><infon key="identifier">MESH:D2</infon><location offset="6" length="3"/><text>ill</text></annotation></passage>
<relation id="r"><infon key="type">Association</infon><node refid="b" role="object"/><node refid="a" role="subject"/></relation>
<relation id="q"><infon key="type">Cause</infon><infon key="role1">Chemical|MESH:C1</infon><infon key="role2">MESH:D1</infon></relation></document>"""


def test_xml_and_tabbed_releases_agree(spark):
    rows = xml.parsed(spark.createDataFrame([(ANNOTATED,), ("<document><id>x</id></document>",)], "xml string"))
    assert sorted((e.start_offset, e.end_offset, e.entity_type, e.concept_id_raw) for e in xml.entities(rows, 1).collect()) == [(0, 4, 3, "MESH:C1"), (6, 9, 2, "MESH:D1")]
    found = sorted((r.relation_type, r.subject_entity_id, r.object_entity_id, r.subject_type, r.object_type) for r in xml.relations(rows, 1).collect())
    assert found == [(1, "MESH:C1", "MESH:D1", 3, 2), (4, "Chemical|MESH:C1", "MESH:D1", 3, 2)]
    lines = spark.createDataFrame([("9\tcause\tChemical|MESH:C1\tMESH:D1",), ("x\tcause\ta\tb",), ("9\todd\ta\tb",), ("9\tcause\ta",)], "value string")
    (tabbed,) = files.relations(lines, 1).collect()
    assert (tabbed.relation_type, tabbed.subject_entity_id, tabbed.object_entity_id, tabbed.subject_type, tabbed.object_type) == found[1]
    concepts = spark.createDataFrame([("9\tDisease\tMESH:D1\till\tx",), ("9\tOdd\tMESH:D1\till\tx",), ("9\tDisease\t-\till\tx",)], "value string")
    (concept,) = files.bioconcepts(concepts, 1).collect()
    assert (concept.start_offset, concept.end_offset, concept.entity_type) == (0, 0, 2)


def test_selection_scenario(spark):
    """Seven papers: what is admitted, promoted, scored and ranked."""
    venue = {101: "Journal of affective disorders", 102: "Frontiers in Neuropharmacology"}
    year = {104: None, 107: 2008}
    ids = range(101, 108)
    papers = spark.createDataFrame([(str(i), i, i, venue.get(i, "General medicine"), year.get(i, 2025), None, None, i == 101, "abstract") for i in ids], "paper_id string, corpus_id long, pmid long, venue_raw string, year int, pmc_id string, doi_norm string, is_open_access boolean, abstract string")
    amyloid, delirium = ("amyloid beta", "C0078939", 1), ("delirium", "MESH:D003693", 2)
    mentions = {101: amyloid, 103: amyloid, 105: delirium, 106: amyloid, 107: delirium}
    annotations = spark.createDataFrame([(i, t, m, c) for i, (m, c, t) in mentions.items()], "pmid long, entity_type int, mention_text string, concept_id_raw string")
    relations = spark.createDataFrame([(106, 4, 3, 2, "MESH:D015430")], "pmid long, relation_type int, subject_type int, object_type int, object_entity_id string")
    metrics = spark.createDataFrame([], "citing_paper_id string, reference_out_count long, influential_reference_count long")
    journals = spark.createDataFrame([("journal of affective disorders",)], "normalized_venue string")
    terms = spark.createDataFrame([("t", "Amyloid", "x")], "term_id string, canonical_name string, category string")
    aliases = spark.createDataFrame([("t", "amyloid beta", True, "amyloid beta")], "term_id string, alias string, is_preferred boolean, normalized_alias string")
    aliases = aliases.unionByName(spark.createDataFrame([("d", "delirium", True, "delirium")], aliases.schema))
    terms = terms.unionByName(spark.createDataFrame([("d", "Delirium", "x")], terms.schema))
    rules = selection.patterns(spark)
    admission = selection.admission_signals(papers, journals, rules, annotations, aliases, terms)
    status = selection.admitted(papers, admission)
    assert {r.corpus_id: r.admission_reason for r in status.collect()} == {101: "journal_and_vocab", 102: "pattern_match", 103: "vocab_entity_match", 104: "selection_retired", 105: "vocab_entity_match", 106: "vocab_entity_match", 107: "vocab_entity_match"}
    signals = selection.mapped_signals(papers, status, journals, rules, annotations, relations, metrics)
    final = selection.promoted(papers, status, signals)
    assert {r.corpus_id: r.domain_status for r in final.collect()} == {101: "mapped", 102: "mapped", 103: "corpus", 104: "retired", 105: "mapped", 106: "mapped", 107: "mapped"}
    summary = selection.selection_summary(papers, final, admission.unionByName(selection.second_gate(signals, final)), annotations, relations, metrics)
    scores = {r.corpus_id: (r.mapped_priority_score, r.evidence_priority_score) for r in summary.collect()}
    assert {i: scores[i] for i in (101, 102, 105, 106, 107)} == {101: (215, 170), 102: (155, 138), 105: (165, 158), 106: (174, 171), 107: (165, 158)}
    none = papers.select("corpus_id").limit(0)
    for most, want in ((10, [106, 101, 105]), (None, [106, 101, 105]), (1, [106])):
        ranked = selection.wave(summary, none, 2015, max_papers=most).orderBy("member_ordinal").collect()
        assert [r.corpus_id for r in ranked] == want and [r.member_ordinal for r in ranked] == list(range(1, len(want) + 1))


def test_insights_golden(spark):
    counts = lambda **v: spark.createDataFrame([*v.items()], "value string, count long")
    rows = {r.value: r.enrichment for r in insights.enrichment(counts(A=100, B=100), counts(A=80, B=20), counts(A=1), 5).collect()}
    assert rows["A"] == pytest.approx(1.6)
    bins = spark.createDataFrame([("c", i, float(i), i + 1.0, n, 30) for i, n in enumerate([10, 10, 10])], "column_key string, bin int, bin_min double, bin_max double, count long, total_count long")
    assert insights.peak_bins(bins).first().bin == 0
    assert insights.diversity(bins).first().normalized_entropy == pytest.approx(1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None)] * 3 + [(2.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    rows = {(r.column_key, r.bin): (r.bin_min, r.bin_max, r["count"]) for r in analytics.histogram(df, ["a", "b", "c"], 500).collect()}
    assert rows == {("a", 0): (1.0, 1 + 1 / 64, 3), ("a", 63): (2 - 1 / 64, 2.0, 1), ("b", 0): (5.0, 5.0, 5)}


def test_guard(spark):
    assert guard.answer(spark, "SELECT * FROM range(500)")["row_count"] == 200
    assert guard.answer(spark, "show tables")["applied_limit"] is None
    for bad in ("SELECT 1; DROP TABLE t", "DROP TABLE t", "", "INSERT INTO t VALUES (1)", "SELECT ';'", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(Exception, match="statement"):
            guard.run(spark, bad)


def test_scopes(spark):
    df = spark.createDataFrame([(i, f"C{i}", i % 3) for i in range(10)], "point_index long, id string, cluster_id long")
    chosen = scope.Selection((scope.Clause("filter:a", F.col("point_index") > 2), scope.Clause("budget:b", F.col("point_index") < 8), scope.Clause("lasso", F.col("point_index") == 5)))
    assert scope.scoped(df, "current", chosen).count() == 5
    assert scope.scoped(df, "current", chosen, without="filter:a").count() == 8
    assert df.filter(chosen.budget()).count() == 7 and df.filter(chosen.intent()).count() == 1 and df.filter(chosen.active()).count() == 1
    assert scope.scoped(df, "selected").count() == 0 and scope.scoped(df, "dataset").count() == 10
    assert scope.table_scope(True, True, "selection") == "current" and scope.table_scope(False, True, "x") == "selected"
    with pytest.raises(ValueError):
        scope.scoped(df, "odd")


def test_numbering_over_partitions(spark):
    df = spark.range(100).filter("id % 3 <> 0").select(F.col("id").alias("i"))
    rows = views.numbered(df, [F.asc("i")], 10, "n").orderBy("i").collect()
    assert [r.n for r in rows] == list(range(10, 10 + len(rows)))


def test_venue_upsert(spark):
    kinds = "venue_id long, source_venue_id string, issn string, name string"
    stored = spark.createDataFrame([(1, "a", "i1", "One"), (2, None, "i2", "Two"), (3, None, None, "Three")], kinds)
    batch = spark.createDataFrame([("a", "i9", "One new"), ("z", "i2", "Two new"), (None, None, " three "), ("n", None, "Fresh"), ("n", None, "Fresh again")], kinds.replace("venue_id long, ", "", 1))
    found = {r.venue_id: (r.source_venue_id, r.issn, r.name) for r in merge.upsert_venues(stored, batch).collect()}
    assert found == {1: ("a", "i9", "One new"), 2: ("z", "i2", "Two new"), 3: (None, None, " three "), 4: ("n", None, "Fresh")}


def test_overlapping_citation_batches(spark):
    batch = spark.createDataFrame([("p", "q", True), ("p", None, None)], "citing_paper_id string, cited_paper_id string, is_influential boolean")
    one_ = merge.reference_metrics(batch)
    assert tuple(merge.summed_metrics(one_, one_).first()) == ("p", 4, 2, 2, 2)


def test_release_files_and_bundle(spark, tmp_path):
    import gzip

    rows = [{"corpusid": 5, "title": " T ", "venue": "V", "year": 2020, "publicationdate": "2020-01-01", "isopenaccess": True, "externalids": {"PubMed": "12", "DOI": "10.1/X"}, "authors": [{"authorId": "1", "name": "A"}, {"name": " "}], "openaccessinfo": {"url": "u", "status": "GOLD"}}]
    path = tmp_path / "papers.jsonl.gz"
    path.write_bytes(gzip.compress("\n".join(map(json.dumps, rows * 3)).encode()))
    raw = files.json_lines(spark, str(path), "papers")
    p = files.papers(raw, 1).first()
    assert (p.paper_id, p.pmid, p.doi_norm, p.title) == ("5", 12, "10.1/x", "T") and len(p.payload_checksum) == 64
    assert [(a.author_ordinal, a.name_raw) for a in files.paper_authors(raw.limit(1)).collect()] == [(0, "A"), (1, "Unknown author")]
    assert files.json_lines(spark, str(path), "papers", per_file=2).count() == 2 and files.paper_assets(raw).count() == 3
    (tmp_path / "bad.jsonl").write_text("[1")
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "papers").collect()
    folder = tmp_path / "bundle"
    folder.mkdir()
    tables = {}
    for name in files.REQUIRED:
        spark.range(3).toPandas().to_parquet(folder / f"{name}.parquet")
        tables[name] = {"file": f"{name}.parquet", "sha256": hashlib.sha256((folder / f"{name}.parquet").read_bytes()).hexdigest()}
    (folder / "manifest.json").write_text(json.dumps({"version": 1, "tables": tables}))
    assert files.open_bundle(spark, str(folder)).table("base_points").count() == 3
    tables["base_points"]["sha256"] = "0"
    (folder / "manifest.json").write_text(json.dumps({"version": 1, "tables": tables}))
    with pytest.raises(ValueError, match="digest"):
        files.open_bundle(spark, str(folder))
    assert files.file_plan({"papers": ["b.jsonl.gz", "a.jsonl.gz"], "authors": ["c.tsv.gz"]}, ["authors", "papers"], 1) == [("authors", "c.tsv.gz", "tsv"), ("papers", "a.jsonl.gz", "json")]


def test_overlay_is_a_value(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    o = overlay.Overlay().replace("a", ids("1", "2", "9"), ids("1", "2", "3"), ids("2")).replace("b", ids("3"), ids("1", "2", "3"), ids("2"))
    assert sorted(r.id for r in o.ids().collect()) == ["1", "3"]
    assert [r.id for r in o.clear("a").ids().collect()] == ["3"] and o.clear_all().ids() is None


def test_means_do_not_depend_on_the_order_of_a_sum(spark):
    """Ten times 0.1, added up one by one, is less than 1; what is no decimal of twelve places is averaged as ever."""
    rows = spark.createDataFrame([(0.1, 1e-300, float("nan"))] * 10, "x double, y double, z double").coalesce(1)
    found = {r["column_key"]: r["avg_value"] for r in analytics.numeric_stats(rows, ["x", "y"]).collect()}
    assert found["x"] == 0.1
    assert abs(found["y"] / 1e-300 - 1) < 1e-12
    large = spark.createDataFrame([(1e30,), (3e30,), (None,)], "x double")
    assert analytics.numeric_stats(large, ["x"]).first()["avg_value"] == 2e30
