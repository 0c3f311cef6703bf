"""Queries over raw release files, documents' parts and what is made of them.

The given tables are first written in the shape of raw releases (lines of JSON, tab-separated lines, XML)
to the shared folder and then read back by the readers that are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import analytics, guard, retrieval, scope, selection, views
from graphloom.operators import documents as docs
from graphloom.plans import standins as s
from graphloom.plans.base import query
from graphloom.plans.standins import PAPERS, POINTS, with_
from graphloom.plans.warehouse import MAPPED, _mapped
from graphloom.sources import files, ledger, merge, xml
from graphloom.sources.files import kept, scratch, table
from graphloom.streaming import ingest


def _json_lines(rows: DataFrame, name: str) -> str:
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", "gzip").json(path)
    return path


def _text_lines(rows: DataFrame, name: str, *values: Column) -> str:
    path = scratch(rows.sparkSession, name)
    rows.select(F.concat_ws("\t", *values).alias("value")).write.option("compression", "gzip").text(path)
    return path


# ---------------------------------------------------------------- bundles and manifests


@query("SELECT count(DISTINCT c_nationkey) AS files, 0 AS mismatched, 1 AS mismatched_if_changed FROM customer")
def src_03(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a release, one folder for each nation, held against stated checksums: all agree, and one that is changed does not."""
    folder = scratch(spark, "stated")
    table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.concat_ws(",", "c_custkey", "c_name").alias("value")).repartition("nation").write.partitionBy("nation").text(folder)
    found = spark.read.format("binaryFile").load(f"{folder}/*/part-*").select(F.regexp_extract("path", "(nation=.*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))
    stated = {r["file"]: r["sha256"] for r in found.collect()}  # as a manifest states them: one entry for each file
    wrong = [len(files.mismatched(spark, folder, d)) for d in (stated, {**stated, min(stated): "0" * 64})]
    return spark.createDataFrame([(len(stated), *wrong)], "files long, mismatched long, mismatched_if_changed long")


# ---------------------------------------------------------------- release files


@query("SELECT 3 AS least, 3 AS most, count(DISTINCT r_regionkey % 2) AS files FROM region")
def src_06(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of each file of JSON lines."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("corpusid"), F.col("c_name").alias("abstract")).filter("corpusid <= 100")
    path = _json_lines(rows.repartitionByRange(2, "corpusid"), "abstracts")
    taken = files.json_lines(spark, path, "abstracts", per_file=3)
    return taken.groupBy(F.col("corpusid") > 50).count().agg(F.min("count").alias("least"), F.max("count").alias("most"), F.count("*").alias("files"))


@query("SELECT 'S' || s_suppkey AS source_venue_id, CASE WHEN s_nationkey > 3 THEN 'i' || s_nationkey END AS issn, CASE WHEN s_suppkey % 7 = 0 THEN 'Unknown venue' ELSE s_name END AS name FROM supplier")
def src_07(spark: SparkSession, sf: str) -> DataFrame:
    """Venues of a release."""
    x = table(spark, sf, "supplier")
    raw = x.select(F.concat(F.lit(" S"), "s_suppkey").alias("id"), F.when(F.col("s_nationkey") > 3, F.concat(F.lit("i"), "s_nationkey")).otherwise("  ").alias("issn"), F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("name"))
    return files.venues(files.json_lines(spark, _json_lines(raw, "venues"), "publication-venues"))


@query("SELECT c_custkey::VARCHAR AS source_author_id, CASE WHEN c_nationkey = 1 THEN 'Unknown author' ELSE c_name END AS name, CASE WHEN c_acctbal > 0 THEN 'o' || c_custkey END AS orcid FROM customer")
def src_08(spark: SparkSession, sf: str) -> DataFrame:
    """Authors of a release."""
    x = table(spark, sf, "customer")
    raw = x.select(F.col("c_custkey").cast("string").alias("authorid"), F.when(F.col("c_nationkey") != 1, F.col("c_name")).alias("name"), F.struct(F.when(F.col("c_acctbal") > 0, F.concat(F.lit("o"), "c_custkey")).alias("ORCID")).alias("externalids"))
    return files.authors(files.json_lines(spark, _json_lines(raw, "authors"), "authors"))


def _raw_papers(spark: SparkSession, sf: str) -> DataFrame:
    x, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    author = F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda i: F.struct(F.when(i != 2, F.concat(key, F.lit("-"), i.cast("string"))).alias("authorId"), F.when(i != 3, F.concat(F.lit("Author "), i.cast("string"))).alias("name")))
    return x.select(
        F.col("p_partkey").alias("corpusid"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise(" ").alias("venue"), (1960 + F.col("p_size")).alias("year"),
        F.when(F.col("p_size") % 2 == 0, F.concat((1960 + F.col("p_size")).cast("string"), F.lit("-03-05"))).otherwise("soon").alias("publicationdate"), (F.col("p_size") > 25).alias("isopenaccess"), F.lit(None).cast("string").alias("publicationvenueid"),
        F.struct(F.when(F.col("p_size") != 9, key).otherwise("x").alias("PubMed"), F.concat(F.lit(" 10.1/AB"), key).alias("DOI"), F.lit(None).cast("string").alias("PubMedCentral")).alias("externalids"), author.alias("authors"),
        F.struct(F.when(F.col("p_size") > 30, F.concat(F.lit("http://x/"), key)).alias("url"), F.lit("gold").alias("status")).alias("openaccessinfo"),
    )


@query("""SELECT p_partkey::VARCHAR AS paper_id, CASE WHEN p_size <> 9 THEN p_partkey END AS pmid, '10.1/ab' || p_partkey AS doi_norm, CASE WHEN p_size > 5 THEN p_brand END AS venue_raw, 1960 + p_size AS year, CASE WHEN p_size % 2 = 0 THEN make_date(1960 + p_size, 3, 5) END AS publication_date, 64 AS checksum_size,
(1 + p_size % 3) AS n_authors, CASE WHEN p_size > 30 THEN 'http://x/' || p_partkey END AS url FROM part""")
def src_09(spark: SparkSession, sf: str) -> DataFrame:
    """Papers of a release with their authors and assets."""
    raw = files.json_lines(spark, _json_lines(_raw_papers(spark, sf), "papers"), "papers")
    papers, authors, assets = files.papers(raw, 1), files.paper_authors(raw), files.paper_assets(raw)
    counted = authors.groupBy("paper_id").agg(F.count("*").alias("n_authors"))
    rows = papers.join(counted, "paper_id").join(assets.select("paper_id", "url"), "paper_id", "left")
    return rows.select("paper_id", "pmid", "doi_norm", "venue_raw", "year", "publication_date", F.length("payload_checksum").alias("checksum_size"), "n_authors", "url")


@query("SELECT doc_id::VARCHAR AS paper_id, nullif(trim(text, ' '), '') AS abstract FROM documents")
def src_10(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as patches of papers."""
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("corpusid"), F.col("text").alias("abstract"))
    return files.patches(files.json_lines(spark, _json_lines(raw, "abstracts"), "abstracts"), "abstract")


@query("""SELECT o_custkey::VARCHAR AS citing_paper_id, CASE WHEN o_totalprice > 50000 THEN o_orderkey::VARCHAR END AS cited_paper_id, 64 AS checksum_size, o_orderstatus = 'F' AS is_influential, true AS differs FROM orders""")
def src_11(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with a checksum over file, line and content: no two are equal."""
    raw = table(spark, sf, "orders").select(F.col("o_orderkey").alias("citationid"), F.col("o_custkey").alias("citingcorpusid"), F.when(F.col("o_totalprice") > 50000, F.col("o_orderkey")).alias("citedcorpusid"), (F.col("o_orderstatus") == "F").alias("isinfluential"), F.array(F.lit(" background "), F.lit(" ")).alias("intents"))
    rows = kept(files.citation_checksums(files.numbered_lines(spark, _json_lines(raw, "citations"))), "checksums")
    once = rows.groupBy("reference_checksum").count().select("reference_checksum", (F.col("count") == 1).alias("differs"))
    return rows.join(once, "reference_checksum").select("citing_paper_id", "cited_paper_id", F.length("reference_checksum").alias("checksum_size"), "is_influential", "differs")


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as a heading, the text as one paragraph, and a heading with another paragraph."""
    x = table(spark, sf, "benchmark").filter("trim(text) <> ''")
    n = F.length("text")
    spans = lambda *pairs: F.to_json(F.array(*(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.struct(F.lit(t).alias("n")).alias("attributes")) for a, b, t in pairs)))
    heads, paragraphs = spans((F.lit(0), F.lit(12), "1"), (13 + n, 13 + n + 7, "1.1")), spans((F.lit(13), 13 + n - 1, None), (14 + n + 7, 14 + n + 11, None))
    body = F.struct(F.concat(F.lit("Introduction\n"), F.substring("text", 1, 1 << 30), F.lit("Methods\nDone")).alias("text"), F.struct(heads.alias("section_header"), paragraphs.alias("paragraph"), F.lit("[]").alias("sentence")).alias("annotations"))
    return x.select(F.col("item_id").alias("corpusid"), body.alias("body"))


@query("""SELECT item_id::VARCHAR AS paper_id, unnest([0, 1]) AS section_ordinal, unnest([NULL, 0]) AS parent_section_ordinal, unnest(['introduction', 'methods']) AS section_role, unnest(['Introduction', 'Methods']) AS display_label FROM benchmark WHERE trim(text, ' ') <> ''""")
def src_12(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of annotated documents of a release."""
    raw = files.json_lines(spark, _json_lines(_annotated(spark, sf), "s2orc"), "s2orc_v2")
    return docs.spine(docs.structured(docs.annotated(raw)), "sections").select("paper_id", "section_ordinal", "parent_section_ordinal", "section_role", "display_label")


@query("""SELECT item_id::VARCHAR AS paper_id, unnest([0, 1]) AS block_ordinal, unnest([0, 1]) AS section_ordinal, unnest(['introduction', 'methods']) AS section_role, true AS is_retrieval_default, trim(unnest([substr(text, 1, length(text) - 1), 'Done']), ' ') AS text, true AS has_sentences FROM benchmark WHERE trim(text, ' ') <> ''""")
def jon_21(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of annotated documents, and whether each has sentences within it."""
    raw = files.json_lines(spark, _json_lines(_annotated(spark, sf), "s2orc"), "s2orc_v2")
    found = kept(docs.structured(docs.annotated(raw)), "structured")
    inside = docs.spine(found, "sentences").select("paper_id", "block_ordinal").distinct().withColumn("has_sentences", F.lit(True))
    return docs.spine(found, "blocks").join(inside, ["paper_id", "block_ordinal"], "left").select("paper_id", "block_ordinal", "section_ordinal", "section_role", "is_retrieval_default", "text", F.coalesce("has_sentences", F.lit(False)).alias("has_sentences"))


def _bioc(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as annotated XML: a chemical, a disease and a relation between them, by nodes or by roles."""
    key = F.col("p_partkey").cast("string")
    mention = lambda name, kind, identifier, at: f'<annotation id="{name}"><infon key="type">{kind}</infon><infon key="identifier">{identifier}</infon><location offset="{at}" length="4"/><text>word</text></annotation>'
    head = F.concat(F.lit("<document><id>"), key, F.lit('</id><passage><infon key="type">title</infon><offset>0</offset><text>x</text>' + mention("a", "Chemical", "MESH:C1", 0) + mention("b", "Disease", "MESH:D1", 6) + "</passage>"))
    by_node = '<relation id="r"><infon key="type">Association</infon><node refid="b" role="object"/><node refid="a" role="subject"/></relation>'
    by_role = '<relation id="q"><infon key="type">Cause</infon><infon key="role1">Chemical|MESH:C2</infon><infon key="role2">MESH:D2</infon></relation>'
    broken = F.when(F.col("p_size") == 3, "").otherwise("</document>")
    return table(spark, sf, "part").select(F.concat(head, F.when(F.col("p_size") > 25, by_node).otherwise(by_role), broken).alias("xml"))


@query("SELECT p_partkey AS pmid, unnest([0, 6]) AS start_offset, unnest([4, 10]) AS end_offset, unnest([3, 2]) AS entity_type, unnest(['MESH:C1', 'MESH:D1']) AS concept_id_raw FROM part WHERE p_size <> 3")
def src_13(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of annotated XML; documents that can't be read give none."""
    return xml.entities(xml.parsed(_bioc(spark, sf)), 1).select("pmid", "start_offset", "end_offset", "entity_type", "concept_id_raw")


@query("SELECT p_partkey AS pmid, unnest([0, 6]) AS start_offset, unnest([4, 10]) AS end_offset, unnest([3, 2]) AS entity_type, unnest(['MESH:C1', 'MESH:D1']) AS concept_id_raw FROM part WHERE p_size <> 3")
def src_13_archives(spark: SparkSession, sf: str) -> DataFrame:
    """The same from compressed collections, unpacked as streams."""
    folder = scratch(spark, "collections")
    collection = F.concat(F.lit("<collection><source>x</source>"), F.array_join(F.collect_list("xml"), "\n"), F.lit("</collection>"))
    # A hundred documents make a collection, so a row stays small.
    rows = _bioc(spark, sf).withColumn("n", F.pmod(F.xxhash64("xml"), F.lit(max(1, table(spark, sf, "part").count() // 100))))
    rows.groupBy("n").agg(collection.alias("value")).select("value").write.option("compression", "gzip").text(folder)
    return xml.entities(xml.parsed(xml.archived_documents(spark, folder)), 1).select("pmid", "start_offset", "end_offset", "entity_type", "concept_id_raw")


@query("SELECT p_partkey AS pmid, CASE WHEN p_size > 25 THEN 1 ELSE 4 END AS relation_type, CASE WHEN p_size > 25 THEN 'MESH:C1' ELSE 'Chemical|MESH:C2' END AS subject_entity_id, CASE WHEN p_size > 25 THEN 'MESH:D1' ELSE 'MESH:D2' END AS object_entity_id, 3 AS subject_type, 2 AS object_type FROM part WHERE p_size <> 3")
def doc_03(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of annotated XML, by nodes or by roles."""
    return xml.relations(xml.parsed(_bioc(spark, sf)), 1).select("pmid", "relation_type", "subject_entity_id", "object_entity_id", "subject_type", "object_type")


@query("SELECT user_id AS pmid, CASE WHEN event_type = 'view' THEN 3 ELSE 2 END AS entity_type, event_type AS mention_text, 'MESH:' || event_id AS concept_id_raw, 0 AS start_offset, 0 AS end_offset FROM events WHERE event_type <> 'click'")
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    """Entity lines."""
    e, kind = table(spark, sf, "events"), F.col("event_type")
    named = F.when(kind == "view", "Chemical").when(kind == "click", "Nothing").otherwise("Disease")
    path = _text_lines(e, "bioconcepts", F.col("user_id").cast("string"), named, F.concat(F.lit("MESH:"), "event_id"), kind, F.lit("x"))
    return files.bioconcepts(spark.read.text(path), 1).select("pmid", "entity_type", "mention_text", "concept_id_raw", "start_offset", "end_offset")


@query("SELECT user_id AS pmid, CASE WHEN value > 50 THEN 4 ELSE 1 END AS relation_type, 'Chemical|MESH:C' || event_id AS subject_entity_id, 'NCBIGene:' || user_id AS object_entity_id, 3 AS subject_type, 1 AS object_type FROM events WHERE event_type <> 'click'")
def src_15(spark: SparkSession, sf: str) -> DataFrame:
    """Relation lines."""
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "odd").when(F.col("value") > 50, "cause").otherwise("Association")
    path = _text_lines(e, "relations", F.col("user_id").cast("string"), kind, F.concat(F.lit("Chemical|MESH:C"), "event_id"), F.concat(F.lit("NCBIGene:"), "user_id"))
    return files.relations(spark.read.text(path), 1).select("pmid", "relation_type", "subject_entity_id", "object_entity_id", "subject_type", "object_type")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS canonical_name, CASE WHEN p_size > 10 THEN 'a|b' ELSE '' END AS semantic_types FROM part WHERE p_size <> 4")
def src_18(spark: SparkSession, sf: str) -> DataFrame:
    """A curated file with a header; rows without a name go."""
    x, path = table(spark, sf, "part"), scratch(spark, "terms")
    rows = x.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") != 4, F.col("p_name")).alias("canonical_name"), F.when(F.col("p_size") > 10, "{a,b}").otherwise("{}").alias("semantic_types"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return files.vocabulary(spark, path).select("id", "canonical_name", F.array_join("semantic_types", "|").alias("semantic_types"))


@query("""SELECT DISTINCT trim(regexp_replace(lower(unnest([p_brand, p_type])), '\\s*:\\s*.*$', '')) AS normalized_venue FROM part""")
def src_19(spark: SparkSession, sf: str) -> DataFrame:
    """Clean names of a journal inventory."""
    raw = table(spark, sf, "part").select(F.concat(F.lit("The "), "p_brand", F.lit(": a part.")).alias("title"), F.concat(F.col("p_type"), F.lit(" (x)..")).alias("medline_abbr"))
    path = _json_lines(raw, "inventory")
    return files.journal_names(spark.read.schema("title string, medline_abbr string").json(path))


@query(with_(POINTS) + "SELECT id, x, y FROM points")
def src_22(spark: SparkSession, sf: str) -> DataFrame:
    """Points of a release in order of their index."""
    path = files.publish(s.points(spark, sf), scratch(spark, "release"), "points")
    return views.by_index(spark.read.parquet(path), ["id", "x", "y"]).select("id", "x", "y")


# ---------------------------------------------------------------- sinks


@query("SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_custkey END)::BIGINT AS keys FROM customer GROUP BY c_mktsegment")
def snk_02(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended batch by batch; one slice written anew."""
    c, path = table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), scratch(spark, "appended")
    for batch in (c.filter("c_custkey % 2 = 0"), c.filter("c_custkey % 2 = 1")):
        files.append(batch, path, ["c_mktsegment"])
    files.overwrite_slices(c.filter("c_mktsegment = 'BUILDING'").withColumn("c_custkey", F.lit(0).cast("long")), path, ["c_mktsegment"])
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN '{"c_name":"new","c_address":null}' ELSE '{"c_name":"' || c_name || '","c_address":null}' END AS payload FROM customer""")
def snk_05(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of documents replaced by key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("c_address"), "c_acctbal")
    batch = c.filter("c_acctbal > 9000").withColumn("c_name", F.lit("new"))
    return merge.replace(merge.with_payloads(c.drop("c_acctbal"), "c_custkey"), merge.with_payloads(batch.drop("c_acctbal"), "c_custkey"), ["c_custkey"])


@query("""SELECT 'orders' AS part, o_custkey AS doc, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE count(*) END AS n FROM orders GROUP BY o_custkey
UNION ALL SELECT 'customers', c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 5 = 0)""")
def snk_11(spark: SparkSession, sf: str) -> DataFrame:
    """All parts of the documents of a batch replaced, in every table."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("n"))
    stored = {"orders": orders, "customers": table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc"), F.lit(1).cast("long").alias("n"))}
    batch = {"orders": orders.filter("doc % 5 = 0").withColumn("n", F.lit(-1).cast("long")), "customers": stored["customers"].limit(0)}
    found = merge.replaced_spine(stored, batch, "doc")
    return found["orders"].select(F.lit("orders").alias("part"), "doc", "n").unionByName(found["customers"].select(F.lit("customers").alias("part"), "doc", "n"))


# ---------------------------------------------------------------- texts


@query(r"""SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(p_brand), '\.+$', ''), '\s+$', ''), '') AS curated, lower(p_brand) || '.' AS venue FROM part""")
def scl_03(spark: SparkSession, sf: str) -> DataFrame:
    """The two ways to clean a name differ in last full stops."""
    raw = F.concat(F.lit("\tThe "), "p_brand", F.lit(".."))
    return table(spark, sf, "part").select("p_partkey", text.clean_inventory_name(raw).alias("curated"), text.clean_venue(F.concat(F.lit("The "), "p_brand", F.lit(".."))).alias("venue"))


BIOC = """<collection><document><passage><infon key="type">front</infon><offset>0</offset><text>T</text></passage>"""


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    passage = lambda kind, section, at, words: F.concat(F.lit(f'<passage><infon key="type">{kind}</infon><infon key="section_type">{section}</infon><offset>{at}</offset><text>'), words, F.lit("</text></passage>"))
    parts = [passage("abstract", "ABSTRACT", 10, F.col("p_name")), passage("title_1", "INTRO", 200, F.lit("Background")), passage("paragraph", "INTRO", 220, F.concat(F.lit("Part "), key, F.lit(". End."))), passage("title_1", "INTRO", 300, F.lit("Effects of")), passage("fig_caption", "FIG", 400, F.lit("Figure")), passage("paragraph", "REF", 500, F.lit("Cited."))]
    whole = F.concat(F.lit(BIOC), *parts, F.when(F.col("p_size") == 3, "").otherwise("</document></collection>"))
    return docs.passages(table(spark, sf, "part").select(key.alias("corpus_id"), whole.alias("xml")))


@query("""SELECT p_partkey::VARCHAR AS corpus_id, unnest([0, 1, 2, 3]) AS block_ordinal, unnest([1, 2, 2, 2]) AS section_ordinal, unnest(['Abstract', 'Background', 'Background', 'Background']) AS display_label, unnest(['abstract', 'introduction', 'introduction', 'introduction']) AS section_role,
unnest(['paragraph', 'paragraph', 'figure_caption', 'paragraph']) AS block_kind, unnest([true, true, true, false]) AS is_retrieval_default, unnest([p_name, 'Part ' || p_partkey || '. End.', 'Figure', 'Cited.']) AS text FROM part WHERE p_size <> 3""")
def doc_02(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of passages: headings open sections, broken ones don't, references aren't searched (DOC-02, SCL-10)."""
    return docs.bioc_blocks(_passages(spark, sf)).select("corpus_id", "block_ordinal", "section_ordinal", "display_label", "section_role", "block_kind", "is_retrieval_default", "text")


@query("""SELECT DISTINCT CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'sentence_window' WHEN p_size % 5 = 0 THEN 'abstract_conclusion' WHEN p_size % 5 = 1 THEN 'results_paragraph' ELSE 'paragraph' END AS kind, p_size FROM part""")
def doc_06(spark: SparkSession, sf: str) -> DataFrame:
    """What chunks are evidence of."""
    size = F.col("p_size")
    role = F.when(size % 5 == 0, "abstract").when(size % 5 == 1, "results").when(size % 5 == 2, "results").otherwise("methods")
    kind = F.when(size % 5 == 2, "figure_caption").otherwise("paragraph")
    return table(spark, sf, "part").select(docs.evidence_kind(role, kind, (size % 2 == 0) & (size % 3 == 0)).alias("kind"), "p_size").distinct()


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE 'a,b,' || c_mktsegment END AS phases, CASE WHEN c_nationkey > 3 THEN 'P' || c_custkey || ',x' ELSE 'x' END AS refs FROM customer")
def scl_22(spark: SparkSession, sf: str) -> DataFrame:
    """Values appended if absent; references without repeats (SCL-19, SCL-22)."""
    phase = F.when(F.col("c_custkey") % 3 == 0, "b").otherwise(F.col("c_mktsegment"))
    refs = F.array(F.when(F.col("c_nationkey") > 3, F.concat(F.lit(" P"), "c_custkey")), F.lit("x"), F.lit(" "), F.lit("x "))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(text.appended(F.array(F.lit("a"), F.lit("b")), phase), ",").alias("phases"), F.array_join(text.paper_references(refs), ",").alias("refs"))


NAMESPACE, VERSION = "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "00000000-0000-0000-0000-000000000001"


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(concat_ws('|', l_orderkey, l_linenumber, 0, 1, 2, 3, '{VERSION}'))) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS evidence_key FROM d""")
def scl_23(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of evidence units by name."""
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", text.evidence_key(NAMESPACE, F.lit(VERSION), F.col("l_orderkey"), F.col("l_linenumber"), *map(F.lit, (0, 1, 2, 3))).alias("evidence_key"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate IS NULL OR year(o_orderdate) >= 1995 - 10 + 9")
def scl_20(spark: SparkSession, sf: str) -> DataFrame:
    """Rows from the year floor on, the present year being given."""
    rows = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return rows.filter(scope.year_from("year", selection.year_floor(1995 + 9))).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- scopes, projections, audits


@query("SELECT r_regionkey, r_name FROM region")
def flt_10(spark: SparkSession, sf: str) -> DataFrame:
    """A user's read-only statement."""
    table(spark, sf, "region").createOrReplaceTempView("graphloom_region")
    return guard.run(spark, "SELECT r_regionkey, r_name FROM graphloom_region;")


@query("SELECT event_id FROM events WHERE event_type = 'view' AND value > 50")
def flt_16(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations with a place their source does not state, of runs over that source's releases."""
    e = table(spark, sf, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(2).alias("resource"), F.when(F.col("value") > 50, 7).otherwise(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("last_seen_run_id"))
    runs = spark.createDataFrame([(1, 10), (2, 20)], "ingest_run_id int, source_release_id int")
    releases = spark.createDataFrame([(10, "tagger"), (20, "catalogue")], "source_release_id int, source_name string")
    return docs.loaded_by(docs.misplaced(rows), runs, releases, ["tagger"]).select("event_id")


@query("SELECT c_custkey AS corpus_id FROM customer WHERE c_nationkey < 12 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND c_custkey % 3 = 0")
def flt_18(spark: SparkSession, sf: str) -> DataFrame:
    """Papers that a bundle takes."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey").alias("corpus_id")
    status = c.select(key, F.when(F.col("c_nationkey") < 12, "mapped").otherwise("corpus").alias("domain_status"), F.when(F.col("c_mktsegment") == "BUILDING", "ready").when(F.col("c_mktsegment") == "MACHINERY", "mapped").otherwise("new").alias("layout_status"))
    texts = c.select(key, F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("text_availability"))
    embeddings = c.filter("c_custkey % 3 = 0").select(key, F.lit(1).alias("model_key")).unionByName(c.select(key, F.lit(2).alias("model_key")))
    return docs.bundle_eligible(status, embeddings, texts)


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("P"), "c_custkey").alias("paper_id"), F.lit("doc").alias("title"))
    return views.paper_catalog(s.points(spark, sf), documents)


@query(with_(POINTS) + "SELECT paper_id, citekey, title, journal, year, paper_reference_count AS reference_count, 1 AS graph_point_count FROM points WHERE paper_id = (SELECT min(paper_id) FROM points WHERE paper_id LIKE 'P1%')")
def prj_07(spark: SparkSession, sf: str) -> DataFrame:
    """One paper's detail."""
    catalog = _catalog(spark, sf)
    name = catalog.filter("paper_id like 'P1%'").agg(F.min("paper_id")).first()[0]
    return views.paper_detail(catalog, name).select("paper_id", "citekey", "title", "journal", "year", "reference_count", "graph_point_count")


@query(with_(PAPERS) + """SELECT corpus_id, '{"pmid":' || coalesce(pmid::VARCHAR, 'null') || ',"year":' || coalesce(year::VARCHAR, 'null') || '}' AS detail FROM papers""")
def prj_09(spark: SparkSession, sf: str) -> DataFrame:
    """Details as JSON objects, nulls kept."""
    return s.papers(spark, sf).select("corpus_id", F.to_json(F.struct("pmid", "year"), {"ignoreNullFields": "false"}).alias("detail"))


@query(with_(POINTS) + """SELECT p.id, p.cluster_id AS cluster, c.n AS members, c.first AS first_exemplar, p.title AS paper_title FROM (SELECT * FROM points WHERE paper_id IS NOT NULL ORDER BY point_index LIMIT 3) p
JOIN (SELECT cluster_id, count(*) AS n, min_by(id, point_index) AS first FROM points GROUP BY 1) c USING (cluster_id)""")
def tbl_07(spark: SparkSession, sf: str) -> DataFrame:
    """Selected points with cluster, exemplars and paper."""
    p = s.points(spark, sf)
    clusters = p.groupBy("cluster_id").agg(F.count("*").alias("member_count"))
    exemplars = p.select("cluster_id", F.col("point_index").alias("rank"), F.col("id").alias("node_id"))
    few = p.filter("paper_id is not null").orderBy("point_index").limit(3)
    found = views.selection_detail(few, clusters, exemplars, _catalog(spark, sf))
    return found.select("id", F.col("cluster.cluster_id").alias("cluster"), F.col("cluster.member_count").alias("members"), F.get("exemplars", F.lit(0)).alias("first_exemplar"), F.col("paper.title").alias("paper_title"))


@query("SELECT o_orderkey AS corpus_id, member_ordinal FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS member_ordinal FROM orders) WHERE o_orderkey % 2 = 1 ORDER BY member_ordinal LIMIT 40")
def tbl_10(spark: SparkSession, sf: str) -> DataFrame:
    """The next members of a wave that were not sent."""
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "corpus_id")
    members = views.numbered(orders.select("corpus_id", "o_totalprice"), [F.desc("o_totalprice"), F.asc("corpus_id")], 1, "member_ordinal")
    return selection.drained(members, orders.filter("corpus_id % 2 = 0"), 40).select("corpus_id", "member_ordinal")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 1")
def tbl_11(spark: SparkSession, sf: str) -> DataFrame:
    """The run that started last."""
    last = table(spark, sf, "events").groupBy("ts").agg(F.min("event_id").alias("event_id"))
    return merge.latest(last, "ts").select("event_id")


# ---------------------------------------------------------------- panels

LAYERS = "layers AS (SELECT 'dataset' AS layer, * FROM points UNION ALL SELECT 'selection', * FROM points WHERE x > 5000 UNION ALL SELECT 'filtered', * FROM points WHERE year >= 1993)"


def _layers(spark: SparkSession, sf: str):
    p = s.points(spark, sf)
    return p, p.filter("x > 5000"), p.filter("year >= 1993")


@query(with_(POINTS, LAYERS) + "SELECT layer, 'journal' AS column_key, journal AS value, count(*) AS count FROM layers WHERE journal <> '' GROUP BY layer, journal")
def agg_24(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a panel's columns on every layer."""
    return analytics.panel(*_layers(spark, sf), ["journal"], [])[0].select("layer", "column_key", "value", "count")


@query(with_(POINTS, LAYERS) + """, bounds AS (SELECT quantile_cont(paper_reference_count, 0.05) AS low, quantile_cont(paper_reference_count, 0.95) AS high FROM points),
placed AS (SELECT layer, least(greatest(floor((least(greatest(paper_reference_count, low), high) - low) / ((high - low) / 16)), 0), 15)::INT AS bin FROM layers, bounds WHERE paper_reference_count IS NOT NULL)
SELECT layer, 'paper_reference_count' AS column_key, bin, count(*) AS count FROM placed GROUP BY layer, bin""")
def anl_10(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of counts between their outer quantiles, the same bins on every layer."""
    return analytics.panel(*_layers(spark, sf), [], ["paper_reference_count"])[1].select("layer", "column_key", "bin", "count")


@query(with_(POINTS) + """SELECT 'semantic_groups' AS column_key, value, count(*) AS count FROM (SELECT unnest(string_split(semantic_groups, ', ')) AS value FROM points WHERE year >= 1993) GROUP BY value ORDER BY count DESC, value LIMIT 8""")
def agg_23(spark: SparkSession, sf: str) -> DataFrame:
    """A session's bars: of the current scope, multiple values cut."""
    p, _, current = _layers(spark, sf)
    return analytics.session_bars(p, {"current": current}, "current", ["semantic_groups"], multiple=["semantic_groups"]).select("column_key", "value", "count")


# ---------------------------------------------------------------- materialisation, cards, answers

def _canonical(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p, _, _, final, annotations, relations, _ = _mapped(spark, sf)
    papers = p.withColumn("source_venue_id", F.when(F.col("corpus_id") % 3 == 0, F.concat(F.lit("V"), F.col("corpus_id") % 10)))
    names = p.select(F.col("venue_raw").alias("name")).distinct()
    venues = spark.range(10).select(F.col("id").alias("venue_id"), F.concat(F.lit("V"), "id").alias("source_venue_id"), F.lit(None).cast("string").alias("name")).unionByName(names.select((1000 + F.length("name")).cast("long").alias("venue_id"), F.lit(None).cast("string").alias("source_venue_id"), "name"))
    authors_raw = p.select("paper_id", F.lit(0).alias("author_ordinal"), F.when(F.col("corpus_id") % 2 == 0, F.concat(F.lit("A"), F.col("corpus_id") % 50)).alias("source_author_id"), F.concat(F.lit("Name "), F.col("corpus_id") % 50).alias("name_raw"))
    authors = spark.createDataFrame([("A0", "Old name"), (None, "Name 1")], "source_author_id string, display_name string")
    placed = annotations.withColumns({"start_offset": F.lit(0), "end_offset": F.lit(0), "resource": F.lit(1)})
    return selection.materialised(papers, final, venues, authors_raw, authors, placed, relations)


@query(MAPPED + """SELECT corpus_id, CASE WHEN corpus_id % 3 = 0 THEN corpus_id % 10 ELSE 1000 + length(venue_raw) END AS venue_id, year, pmid, paper_id AS s2_paper_id, substr(sha1(coalesce(title, '')), 1, 32) AS title_hash, substr(sha1(abstract), 1, 32) AS abstract_hash, (abstract IS NOT NULL)::INT AS text_availability
FROM papers JOIN final USING (corpus_id) WHERE domain_status IN ('corpus', 'mapped')""")
def sel_09(spark: SparkSession, sf: str) -> DataFrame:
    """Papers and texts of a release, as they are published."""
    made = _canonical(spark, sf)
    return made["papers"].join(made["paper_text"], "corpus_id").select("corpus_id", "venue_id", "year", "pmid", "s2_paper_id", "title_hash", "abstract_hash", "text_availability")


@query(MAPPED + """, mapped AS (SELECT corpus_id, pmid FROM papers JOIN final USING (corpus_id) WHERE domain_status = 'mapped')
SELECT 'entity' AS kind, corpus_id, concept_id_raw AS a, '' AS b, count(DISTINCT entity_type) AS n FROM annotations JOIN mapped USING (pmid) GROUP BY ALL
UNION ALL SELECT 'relation', corpus_id, subject_entity_id, object_entity_id, count(DISTINCT relation_type) FROM relations JOIN mapped USING (pmid) WHERE relation_source = 1 GROUP BY ALL
UNION ALL SELECT 'author', corpus_id, CASE WHEN corpus_id % 2 = 0 THEN 'A' || corpus_id % 50 END, 'Name ' || corpus_id % 50, 1 FROM mapped""")
def sel_09_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations, relations and authors of mapped papers, as they are published."""
    made = _canonical(spark, sf)
    entities = made["entity_annotations"].groupBy("corpus_id", F.col("concept_id_raw").alias("a")).agg(F.count("*").alias("n")).select(F.lit("entity").alias("kind"), "corpus_id", "a", F.lit("").alias("b"), "n")
    relations = made["relations"].groupBy("corpus_id", F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "corpus_id", "a", "b", "n")
    authors = made["paper_authors"].select(F.lit("author").alias("kind"), "corpus_id", F.col("source_author_id").alias("a"), F.col("display_name").alias("b"), F.lit(1).cast("long").alias("n"))
    return entities.unionByName(relations).unionByName(authors)


@query("""SELECT c_custkey AS corpus_id, coalesce(n, 0) AS citation_count, coalesce(f, 0) AS influential_citation_count, c_nationkey::BIGINT AS publication_year, 2 AS package_tier, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS text_availability, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS display_title,
'First, Second' AS author_line, n_name AS venue_display, '{"pmid":' || c_custkey || ',"doi":null,"pmc":null,"s2":"' || c_custkey || '"}' AS external_ids
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0""")
def ret_10(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of members."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey").alias("corpus_id")
    none = F.lit(None).cast("string")
    papers = c.select(key, F.col("c_nationkey").alias("year"), F.col("c_nationkey").alias("venue_id"), F.col("c_custkey").alias("pmid"), none.alias("doi_norm"), none.alias("pmc_id"), F.col("c_custkey").cast("string").alias("s2_paper_id"))
    members = c.filter("c_acctbal > 0").select(key, F.lit(2).alias("package_tier"))
    texts = c.filter("c_custkey % 2 = 0").select(key, F.lit(1).alias("text_availability"), F.col("c_name").alias("title"))
    metrics = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("corpus_id")).agg(F.count("*").alias("citation_in_count"), F.count_if(F.col("o_orderstatus") == "F").alias("influential_citation_count"))
    venues = table(spark, sf, "nation").select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("display_name"))
    authors = c.select(key, F.explode(F.array(F.struct(F.lit(1).alias("author_ordinal"), F.lit("Second").alias("display_name")), F.struct(F.lit(0).alias("author_ordinal"), F.lit("First").alias("display_name")))).alias("a")).select("corpus_id", "a.*")
    return retrieval.cards(papers, members, texts, metrics, venues, authors)


@query(with_(POINTS) + """, r AS (SELECT DISTINCT 'C' || (o_orderkey % 4000) AS id FROM orders) SELECT r.id, CASE WHEN b.id IS NOT NULL THEN 'base' WHEN u.id IS NOT NULL THEN 'universe' ELSE 'missing' END AS store,
CASE WHEN b.id IS NOT NULL THEN 'active' WHEN u.id IS NOT NULL THEN 'promoted' ELSE 'evidence_only' END AS role FROM r LEFT JOIN (SELECT id FROM points WHERE is_in_base) b USING (id) LEFT JOIN points u USING (id)""")
def ret_11(spark: SparkSession, sf: str) -> DataFrame:
    """Where the papers of an answer are drawn."""
    p = s.points(spark, sf)
    references = table(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_orderkey") % 4000).alias("id"))
    return retrieval.answer_sync(references, ("base", p.filter("is_in_base")), ("universe", p))


@query(r"""WITH d(entity_id, entity_type, term) AS (VALUES ('e1', 'x', 'the'), ('e2', 'x', 'and')), w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT item_id, entity_id, entity_type, list_position(w, term) - 1 AS "at", len(w) AS size FROM w, d WHERE list_contains(w, term))
SELECT item_id, entity_id, "at", round(1 - "at" / size, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY 1 - "at" / size DESC, entity_id) <= 1""")
def ret_12(spark: SparkSession, sf: str) -> DataFrame:
    """The first entity of some types that texts name."""
    dictionary = spark.createDataFrame([("e1", "x", "The"), ("e2", "x", "and"), ("e3", "y", "of")], "entity_id string, entity_type string, matched_text string")
    found = retrieval.entity_matches(table(spark, sf, "benchmark"), dictionary, 1, ["x"], "item_id")
    return found.select("item_id", "entity_id", "at", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- streams


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_03(spark: SparkSession, sf: str) -> DataFrame:
    """A load that stops after its first file and goes on from its checkpoint: no row is lost or twice there."""
    events, folder = table(spark, sf, "events"), scratch(spark, "resumed")
    events.select("event_id", "user_id", "event_type").repartition(4, "event_id").write.parquet(f"{folder}/in")
    schema = events.select("event_id", "user_id", "event_type").schema
    sink, done = ingest.appending(f"{folder}/rows"), []

    def fails_once(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        if number == 1 and not done:
            done.append(number)
            raise RuntimeError("stopped within a batch")

    for _ in range(2):
        run = ingest.load(ingest.files(spark, f"{folder}/in", schema, per_trigger=1), f"{folder}/checkpoint", fails_once)
        try:
            run.awaitTermination()
        except Exception:  # the first run is meant to stop
            if len(done) > 1:
                raise
    return spark.read.parquet(f"{folder}/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT 'orders' AS family, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part)
SELECT family, rows, CASE family WHEN 'customer' THEN 2 ELSE 1 END::BIGINT AS attempts, 'published' AS status, true AS drift_refused FROM f""")
def str_03_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A run over three families that fails in the second, refuses a plan that drifted, and is taken up where it stopped."""
    folder = scratch(spark, "runs")
    sizes = {name: table(spark, sf, name).count() for name in ("orders", "customer", "part")}
    plan = {"schema_version": 1, "source_code": "tables", "release_tag": "r1", "families": [{"family": n, "target_tables": [n], "files": [{"dataset": n, "byte_count": c, "content_kind": "parquet"}]} for n, c in sizes.items()]}
    attempts: dict[str, int] = {}

    def load(family: dict) -> None:
        name = family["family"]
        attempts[name] = attempts.get(name, 0) + 1
        table(spark, sf, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        if name == "customer" and attempts[name] == 1:
            raise RuntimeError("stopped within a family")

    try:
        ledger.Run.open(spark, folder, plan).load(load)
    except RuntimeError:
        pass
    drifted = {**plan, "families": [plan["families"][0], {**plan["families"][1], "files": []}, plan["families"][2]]}
    try:
        ledger.Run.open(spark, folder, drifted)
        refused = False
    except ledger.PlanDrift:
        refused = True
    done = ledger.Run.open(spark, folder, plan).load(load)
    rows = None
    for name in sizes:
        counted = spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("family"), F.count("*").alias("rows"), F.lit(attempts[name]).cast("long").alias("attempts"), F.lit(done.state["status"]).alias("status"), F.lit(refused).alias("drift_refused"))
        rows = counted if rows is None else rows.unionByName(counted)
    return rows
