"""Queries over papers, venues, annotations, relations, texts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import codes, text
from graphloom.operators import documents as docs
from graphloom.operators import retrieval, selection
from graphloom.plans import standins as s
from graphloom.plans.base import query
from graphloom.plans.standins import ANNOTATIONS, CITATIONS, JOURNALS, METRICS, PAPERS, PATTERNS, RELATIONS, VOCABULARY, with_
from graphloom.sources import files, ledger, merge
from graphloom.sources.files import kept, scratch, table
from graphloom.streaming import ingest

# ---------------------------------------------------------------- expressions


@query("""SELECT doc_id, lower(trim(text)) AS lowered, nullif(regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g'), '') AS key FROM documents""")
def scl_01(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup keys."""
    return table(spark, sf, "documents").select("doc_id", F.lower(F.trim("text")).alias("lowered"), text.lookup_key(F.col("text")).alias("key"))


@query(with_(PAPERS) + "SELECT paper_id, venue_raw, normalized_venue FROM venues")
def scl_02(spark: SparkSession, sf: str) -> DataFrame:
    """Bare names of venues."""
    return selection.with_venue(s.papers(spark, sf)).select("paper_id", "venue_raw", "normalized_venue")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, nullif(trim(event_type), '') AS kind FROM events")
def scl_04(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as numbers and as trimmed texts."""
    return table(spark, sf, "events").select("event_id", text.whole_number(F.get_json_object("props", "$.k")).alias("k"), text.blank_to_null(F.col("event_type")).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'pmc' || p_partkey ELSE 'PMC' || p_partkey END AS pmc, 'PMC' || p_partkey AS checked FROM part")
def scl_05(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers with their prefix."""
    raw = F.when(F.col("p_size") > 25, F.concat(F.lit("pmc"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.with_pmc_prefix(raw).alias("pmc"), text.pmc_identifier(raw).alias("checked"))


@query("""WITH i AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'MESH:D' || p_partkey WHEN p_size < 20 THEN 'NCBIGene:' || p_partkey WHEN p_size < 30 THEN 'Cell-Line|' || p_partkey WHEN p_size < 40 THEN 'odd|MESH:D1' ELSE p_name END AS identifier FROM part)
SELECT p_partkey, CASE WHEN identifier LIKE 'MESH:%' OR identifier LIKE 'odd|%' THEN 2 WHEN identifier LIKE 'NCBIGene:%' THEN 1 WHEN identifier LIKE 'Cell%' THEN 6 ELSE 3 END::BIGINT AS entity_type FROM i""")
def scl_06(spark: SparkSession, sf: str) -> DataFrame:
    """Types that identifiers show."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    identifier = F.when(size < 10, F.concat(F.lit("MESH:D"), key)).when(size < 20, F.concat(F.lit("NCBIGene:"), key)).when(size < 30, F.concat(F.lit("Cell-Line|"), key)).when(size < 40, "odd|MESH:D1").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", codes.entity_type_of(identifier).alias("entity_type"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 1 END::BIGINT AS code FROM events")
def scl_07(spark: SparkSession, sf: str) -> DataFrame:
    """Relation names as codes (SCL-07, SCL-08)."""
    raw = F.when(F.col("event_type") == "click", " Positive-Correlate").when(F.col("event_type") == "view", "association").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", codes.code_of(codes.relation_name(raw), codes.RELATION_TYPES).alias("code"))


@query("""WITH h AS (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS b FROM documents)
SELECT doc_id, CASE WHEN contains(b, 'abstract') THEN 'abstract' WHEN contains(b, 'introduction') OR b = 'intro' THEN 'introduction' WHEN contains(b, 'method') OR contains(b, 'materials') THEN 'methods' WHEN contains(b, 'result') THEN 'results'
  WHEN contains(b, 'discuss') THEN 'discussion' WHEN contains(b, 'conclusion') THEN 'conclusion' WHEN contains(b, 'supplement') THEN 'supplement' ELSE 'other' END AS role FROM h""")
def scl_09(spark: SparkSession, sf: str) -> DataFrame:
    """Roles that first lines name."""
    return table(spark, sf, "documents").select("doc_id", text.section_role(F.substring_index("text", "\n", 1)).alias("role"))


@query(r"SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM benchmark".replace("SELECT item_id, ", "SELECT item_id, array_to_string(").replace(" AS parts", ", '|') AS parts"))
def scl_11(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of texts."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.sentence_texts(F.col("text")), "|").alias("parts"))


@query("SELECT doc_id, substr(sha1(text), 1, 32) AS short, sha256(concat_ws('|', doc_id::VARCHAR, lang, source)) AS whole FROM documents")
def scl_12(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of texts and of joined columns (SCL-12, SCL-13)."""
    return table(spark, sf, "documents").select("doc_id", text.short_digest(F.col("text")).alias("short"), text.joined_digest("|", F.col("doc_id").cast("string"), F.col("lang"), F.col("source")).alias("whole"))


MARKDOWN = "concat('See [[', split_part(text, ' ', 1), ' Page]], [[pmid:', item_id, ']] and [[Other|shown]].')"


@query(f"WITH m AS (SELECT item_id, {MARKDOWN} AS md FROM benchmark) SELECT item_id, array_to_string(list_transform(regexp_extract_all(md, '\\[\\[([^\\]|:]+)(\\|[^\\]]*)?\\]\\]', 1), lambda x: regexp_replace(lower(trim(x)), '\\s+', '-', 'g')), ',') AS links, item_id AS pmid FROM m")
def scl_18(spark: SparkSession, sf: str) -> DataFrame:
    """Links and citations of marked-up text."""
    md = F.concat(F.lit("See [["), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" Page]], [[pmid:"), F.col("item_id").cast("string"), F.lit("]] and [[Other|shown]]."))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.wiki_links(md), ",").alias("links"), F.get(text.cited_pmids(md), F.lit(0)).alias("pmid"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE (json_extract_string(props, '$.k'))::BIGINT > 50")
def scl_21(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON texts."""
    row = F.from_json("props", "k string")
    return table(spark, sf, "events").select("event_id", row["k"].alias("k")).filter(F.col("k").cast("long") > 50)


@query("""WITH d(entity_id, term) AS (VALUES ('e1', 'the'), ('e2', 'and'), ('e3', 'of the')),
w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), p AS (SELECT item_id, w, unnest(range(len(w))) AS "at" FROM w)
SELECT item_id, entity_id, min(p."at") AS "at" FROM p, d WHERE CASE WHEN contains(term, ' ') THEN w[p."at" + 1] || ' ' || coalesce(w[p."at" + 2], '') ELSE w[p."at" + 1] END = term GROUP BY ALL""")
def scl_25(spark: SparkSession, sf: str) -> DataFrame:
    """Where entities are first named."""
    dictionary = spark.createDataFrame([("e1", "The"), ("e2", "and"), ("e3", "of the")], "entity_id string, matched_text string")
    return retrieval.mentions(table(spark, sf, "benchmark"), dictionary, "item_id")


# ---------------------------------------------------------------- merges


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT c_acctbal > 9000 UNION ALL SELECT c_custkey, 'new', c_acctbal FROM customer WHERE c_acctbal > 9000")
def snk_03(spark: SparkSession, sf: str) -> DataFrame:
    """Rows replaced by key."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return merge.replace(c, c.filter("c_acctbal > 9000").withColumn("c_name", F.lit("new")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_name END AS c_name FROM customer")
def snk_04(spark: SparkSession, sf: str) -> DataFrame:
    """One column patched, to null as well."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    patch = c.filter("c_acctbal > 9000").select("c_custkey", F.lit(None).cast("string").alias("c_name"))
    return merge.patch(c.drop("c_acctbal"), patch, "c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 9000 AND c_nationkey > 5 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'added'")
def snk_06(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert that keeps what the batch does not know."""
    c = table(spark, sf, "customer")
    batch = c.filter("c_acctbal > 9000").select("c_custkey", F.when(F.col("c_nationkey") > 5, "new").alias("c_name")).unionByName(spark.createDataFrame([(-1, "added")], "c_custkey long, c_name string"))
    return merge.upsert_keeping(c.select("c_custkey", "c_name"), batch, ["c_custkey"])


@query("""WITH b AS (SELECT CASE WHEN p_size > 20 THEN 'v' || p_size END AS src, CASE WHEN p_size <= 20 THEN 'i' || p_size END AS issn, 'Part ' || p_brand AS name FROM part),
firsts AS (SELECT src, NULL AS issn, min(name) AS name FROM b WHERE src IS NOT NULL GROUP BY src UNION ALL SELECT NULL, issn, min(name) FROM b WHERE src IS NULL GROUP BY issn),
new AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY src NULLS LAST, issn NULLS LAST) = 1),
stored AS (SELECT s_suppkey AS venue_id, 'v' || s_suppkey AS src, CASE WHEN s_nationkey > 3 THEN 'i' || s_suppkey END AS issn, s_name AS name FROM supplier),
met AS (SELECT venue_id, new.* FROM new JOIN stored ON stored.src = new.src UNION ALL SELECT venue_id, new.* FROM new JOIN stored ON stored.issn = new.issn),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY src NULLS LAST) = 1)
SELECT venue_id, coalesce(b.src, s.src) AS source_venue_id, coalesce(b.issn, s.issn) AS issn, coalesce(b.name, s.name) AS name FROM stored s LEFT JOIN best b USING (venue_id)
UNION ALL SELECT (SELECT max(venue_id) FROM stored) + row_number() OVER (ORDER BY src NULLS LAST, issn NULLS LAST, lower(name)), src, issn, name FROM new
WHERE NOT EXISTS (SELECT 1 FROM stored WHERE stored.src = new.src) AND NOT EXISTS (SELECT 1 FROM stored WHERE stored.issn = new.issn)""")
def snk_07(spark: SparkSession, sf: str) -> DataFrame:
    """Venues merged by source id, ISSN or name."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("venue_id"), F.concat(F.lit("v"), "s_suppkey").alias("source_venue_id"), F.when(F.col("s_nationkey") > 3, F.concat(F.lit("i"), "s_suppkey")).alias("issn"), F.col("s_name").alias("name"))
    batch = table(spark, sf, "part").select(F.when(F.col("p_size") > 20, F.concat(F.lit("v"), "p_size")).alias("source_venue_id"), F.when(F.col("p_size") <= 20, F.concat(F.lit("i"), "p_size")).alias("issn"), F.concat(F.lit("Part "), "p_brand").alias("name"))
    return merge.upsert_venues(suppliers, batch)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def snk_08(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each key, by a tie-break (SNK-08, SNK-09, SET-06)."""
    return merge.first_of(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def snk_10(spark: SparkSession, sf: str) -> DataFrame:
    """A slice replaced."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    batch = c.filter("c_mktsegment = 'BUILDING' and c_acctbal > 0").withColumn("c_acctbal", F.lit(0.0))
    return merge.replace_slice(c, batch, F.col("c_mktsegment") == "BUILDING").drop("c_mktsegment")


@query(with_(CITATIONS, METRICS) + "SELECT * FROM metrics")
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    """Reference metrics of papers."""
    return merge.reference_metrics(s.citations(spark, sf))


@query("SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem")
def win_07(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated rows taken out."""
    columns = ["l_partkey", "l_returnflag", "l_linestatus"]
    return merge.deduplicated(table(spark, sf, "lineitem").select(*columns), columns)


@query(with_(RELATIONS) + "SELECT pmid, relation_type, subject_entity_id, object_entity_id, min(relation_source) AS relation_source FROM relations GROUP BY ALL")
def sel_10(spark: SparkSession, sf: str) -> DataFrame:
    """One relation for each key: the better source's."""
    keys = ["pmid", "relation_type", "subject_entity_id", "object_entity_id"]
    return merge.by_precedence(s.relations(spark, sf).select(*keys, "relation_source"), keys, "relation_source")


@query("""SELECT s_suppkey, coalesce(n1.n_name, n2.n_name) AS country FROM (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS k, s_name, 'NATION_' || (s_suppkey % 25) AS name FROM supplier) x
LEFT JOIN nation n1 ON x.k = n1.n_nationkey LEFT JOIN nation n2 ON x.k IS NULL AND n2.n_name = x.name""")
def jon_15(spark: SparkSession, sf: str) -> DataFrame:
    """A join by key, or by name where there is no key."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")).alias("k"), F.concat(F.lit("NATION_"), F.col("s_suppkey") % 25).alias("n_name"))
    nations = table(spark, sf, "nation")
    known = nations.select(F.col("n_nationkey").alias("k"), F.lit(None).cast("string").alias("n_name"), F.col("n_name").alias("country")).unionByName(nations.select(F.lit(None).cast("int").alias("k"), "n_name", F.col("n_name").alias("country")))
    return merge.joined_either(rows, known, "k", "n_name", "country").select("s_suppkey", "country")


@query(r"""WITH v AS (SELECT p_partkey AS venue_id, p_brand AS brand, p_type AS kind FROM part WHERE p_size > 45)
SELECT c_custkey, (SELECT v.venue_id FROM v WHERE v.brand = 'Brand#' || c_nationkey OR v.kind = upper(CASE WHEN c_mktsegment = 'BUILDING' THEN 'promo' ELSE 'none' END) ORDER BY CASE WHEN v.brand = 'Brand#' || c_nationkey THEN 0 ELSE 1 END, v.venue_id LIMIT 1) AS matched_venue_id FROM customer""")
def jon_14(spark: SparkSession, sf: str) -> DataFrame:
    """The best match by one of two keys."""
    venues = table(spark, sf, "part").filter("p_size > 45").select(F.col("p_partkey").alias("venue_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Brand#"), "c_nationkey").alias("brand"), F.when(F.col("c_mktsegment") == "BUILDING", "PROMO").otherwise("NONE").alias("kind"))
    return merge.best_match(rows, venues, "c_custkey", ["brand", "kind"], ["venue_id"]).select("c_custkey", "matched_venue_id")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'own' END, c_name) AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jon_19(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values filled from another table."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "own").alias("name"))
    return merge.filled(rows, table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name")), "c_custkey", "name").select("o_orderkey", "name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def jon_16(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a partner (JON-16, JON-17, JON-20)."""
    large = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000")
    return table(spark, sf, "customer").join(large.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT c.conv_id, c.turn, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn <= c.turn) AS user_turn FROM conversations c""")
def jon_22(spark: SparkSession, sf: str) -> DataFrame:
    """The last user turn at or before each turn, in one pass over a conversation."""
    from pyspark.sql import Window

    until = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(until).alias("user_turn"))


# ---------------------------------------------------------------- selection


def _inputs(spark: SparkSession, sf: str):
    terms, aliases = s.vocabulary(spark)
    return s.papers(spark, sf), kept(s.journals(spark, sf), "journals"), s.venue_patterns(spark), s.annotations(spark, sf), aliases, terms


HITS = with_(PAPERS, JOURNALS, PATTERNS, ANNOTATIONS, VOCABULARY) + """, signals AS (
  SELECT corpus_id, 'journal_match' AS signal_kind, 'journal_inventory' AS family_key, normalized_venue AS match_value, 1 AS signal_count FROM venues JOIN journals USING (normalized_venue)
  UNION ALL SELECT corpus_id, 'pattern_match', pattern_key, like_pattern, 1 FROM venues JOIN patterns ON normalized_venue LIKE like_pattern
  UNION ALL SELECT corpus_id, 'vocab_entity_match', 'vocab_alias', term_id, count(*) FROM annotations JOIN papers USING (pmid) JOIN aliases ON normalized_alias = nullif(regexp_replace(trim(lower(mention_text)), '\\s+', ' ', 'g'), '') JOIN terms USING (term_id) GROUP BY corpus_id, term_id),
admitted AS (SELECT p.corpus_id, coalesce(j, false) AS j, coalesce(pt, false) AS pt, coalesce(v, false) AS v FROM papers p LEFT JOIN (
  SELECT corpus_id, bool_or(signal_kind = 'journal_match') AS j, bool_or(signal_kind = 'pattern_match') AS pt, bool_or(signal_kind = 'vocab_entity_match') AS v FROM signals GROUP BY corpus_id) r USING (corpus_id)),
status AS (SELECT corpus_id, CASE WHEN j OR pt OR v THEN 'corpus' ELSE 'retired' END AS domain_status, CASE WHEN j AND v THEN 'journal_and_vocab' WHEN j THEN 'journal_match' WHEN pt THEN 'pattern_match' WHEN v THEN 'vocab_entity_match' ELSE 'selection_retired' END AS admission_reason FROM admitted)
"""  # fmt: skip


@query(HITS + "SELECT corpus_id, signal_kind, family_key, match_value, signal_count FROM signals")
def sel_03(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of admission (SEL-01, SEL-03, JON-08 to JON-10, FLT-11)."""
    return selection.admission_signals(*_inputs(spark, sf)).select("corpus_id", "signal_kind", "family_key", "match_value", "signal_count")


@query(with_(PAPERS, ANNOTATIONS, VOCABULARY) + "SELECT corpus_id, term_id, canonical_name, category, coalesce(min(alias) FILTER (WHERE is_preferred), min(alias)) AS matched_alias, count(*) AS signal_count FROM annotations JOIN papers USING (pmid) JOIN aliases ON normalized_alias = trim(lower(mention_text)) JOIN terms USING (term_id) GROUP BY ALL")
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that papers mention, and by which alias."""
    p, _, _, annotations, aliases, terms = _inputs(spark, sf)
    return selection.alias_hits(p, annotations, aliases, terms)


@query(HITS + "SELECT * FROM status")
def sel_04(spark: SparkSession, sf: str) -> DataFrame:
    """Status and reason of every paper."""
    return selection.admitted(s.papers(spark, sf), selection.admission_signals(*_inputs(spark, sf)))


@query(with_(PAPERS) + """, hits AS (SELECT * FROM papers WHERE is_open_access), known AS (SELECT paper_id AS s2_paper_id, corpus_id, pmid FROM papers WHERE year < 1960), own AS (
  SELECT h.paper_id, coalesce(k1.corpus_id, k2.corpus_id) AS corpus_id FROM hits h LEFT JOIN known k1 ON k1.s2_paper_id = h.paper_id LEFT JOIN known k2 ON k2.pmid = h.pmid)
SELECT * FROM own WHERE corpus_id IS NOT NULL UNION ALL SELECT paper_id, (SELECT max(corpus_id) FROM known) + row_number() OVER (ORDER BY length(paper_id), paper_id) FROM own WHERE corpus_id IS NULL""")
def sel_02(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of papers, known or new (SEL-02, JON-11)."""
    p = s.papers(spark, sf)
    known = p.filter("year < 1960").select(F.col("paper_id").alias("s2_paper_id"), "corpus_id", "pmid", "doi_norm", F.lit(None).cast("string").alias("pmc_id"))
    return selection.resolved_ids(p.filter("is_open_access"), p.withColumn("corpus_id", F.lit(None).cast("long")), known)


MAPPED = HITS + "," + ",".join(x.strip() for x in (RELATIONS, CITATIONS, METRICS)) + """, scope AS (SELECT v.* FROM venues v JOIN status USING (corpus_id) WHERE domain_status = 'corpus'),
mapped_signals AS (
  SELECT corpus_id, 'mapped_journal_match' AS signal_kind, 'journal_inventory' AS family_key, normalized_venue AS match_value, 1 AS signal_count, true AS direct, NULL AS confidence FROM scope JOIN journals USING (normalized_venue)
  UNION ALL SELECT corpus_id, 'mapped_pattern_match', pattern_key, like_pattern, 1, true, NULL FROM scope JOIN patterns ON normalized_venue LIKE like_pattern WHERE promotes_to_mapped
  UNION ALL SELECT corpus_id, 'mapped_entity_rule_match', CASE concept_id_raw WHEN '627' THEN 'neurotransmitter_gene' ELSE 'behavior' END, concept_id_raw, count(*), concept_id_raw <> '627', CASE concept_id_raw WHEN '627' THEN 'requires_second_gate' ELSE 'high' END
    FROM annotations JOIN scope USING (pmid) WHERE (entity_type = 2 AND concept_id_raw = 'MESH:D003693') OR (entity_type = 1 AND concept_id_raw = '627') GROUP BY corpus_id, concept_id_raw
  UNION ALL SELECT corpus_id, 'mapped_relation_rule_match', 'metabolic_toxicity', object_entity_id, count(*), true, NULL FROM relations JOIN scope USING (pmid) WHERE subject_type = 3 AND relation_type = 4 AND object_type = 2 AND object_entity_id = 'MESH:D015430' GROUP BY corpus_id, object_entity_id),
final AS (SELECT s.corpus_id, CASE WHEN domain_status <> 'retired' AND (p.year IS NULL OR p.year >= 1945) AND coalesce(d, false) THEN 'mapped' ELSE domain_status END AS domain_status, admission_reason
  FROM status s JOIN papers p USING (corpus_id) LEFT JOIN (SELECT corpus_id, bool_or(direct) AS d FROM mapped_signals GROUP BY corpus_id) USING (corpus_id)),
gated AS (SELECT m.*, CASE WHEN confidence = 'requires_second_gate' THEN domain_status = 'mapped' ELSE direct END AS contributes_to_mapped FROM mapped_signals m JOIN final USING (corpus_id)),
every AS (SELECT corpus_id, signal_kind, family_key, signal_count, false AS contributes_to_mapped FROM signals UNION ALL SELECT corpus_id, signal_kind, family_key, signal_count, contributes_to_mapped FROM gated),
rolled AS (SELECT corpus_id, bool_or(signal_kind = 'journal_match') AS j, bool_or(signal_kind = 'pattern_match') AS pt, bool_or(signal_kind = 'vocab_entity_match') AS v,
  bool_or(signal_kind = 'mapped_journal_match' AND contributes_to_mapped) AS mj, bool_or(signal_kind = 'mapped_pattern_match' AND contributes_to_mapped) AS mp, bool_or(signal_kind = 'mapped_entity_rule_match' AND contributes_to_mapped) AS me, bool_or(signal_kind = 'mapped_relation_rule_match' AND contributes_to_mapped) AS mr,
  coalesce(sum(signal_count) FILTER (WHERE signal_kind = 'vocab_entity_match'), 0) AS vc, coalesce(sum(signal_count) FILTER (WHERE signal_kind = 'mapped_entity_rule_match' AND contributes_to_mapped), 0) AS mec, coalesce(sum(signal_count) FILTER (WHERE signal_kind = 'mapped_relation_rule_match' AND contributes_to_mapped), 0) AS mrc,
  array_to_string(list_sort(list_distinct(list(family_key) FILTER (WHERE contributes_to_mapped))), ',') AS families FROM every GROUP BY corpus_id),
ec AS (SELECT pmid, count(*) AS ec FROM annotations GROUP BY pmid), rc AS (SELECT pmid, count(*) AS rc FROM relations GROUP BY pmid),
base AS (SELECT p.corpus_id, f.domain_status AS current_status, f.admission_reason AS primary_admission_reason, p.year AS publication_year, p.pmc_id IS NOT NULL AS pmc, (p.pmc_id IS NOT NULL OR p.pmid IS NOT NULL) AS loc, coalesce(is_open_access, false) AS oa, p.abstract IS NOT NULL AS ab,
  coalesce(r.j, false) AS j, coalesce(r.pt, false) AS pt, coalesce(r.mj, false) AS mj, coalesce(r.mp, false) AS mp, coalesce(r.me, false) AS me, coalesce(r.mr, false) AS mr, coalesce(r.vc, 0) AS vc, coalesce(r.mec, 0) AS mec, coalesce(r.mrc, 0) AS mrc, coalesce(r.families, '') AS families,
  coalesce(ec.ec, 0) AS ec, coalesce(rc.rc, 0) AS rc, coalesce(m.reference_out_count, 0) AS refs, coalesce(m.influential_reference_count, 0) AS inf
  FROM papers p JOIN final f USING (corpus_id) LEFT JOIN rolled r USING (corpus_id) LEFT JOIN ec ON ec.pmid = p.pmid LEFT JOIN rc ON rc.pmid = p.pmid LEFT JOIN metrics m ON m.citing_paper_id = p.paper_id),
summary AS (SELECT *, 100 * (current_status = 'mapped')::INT + 60 * mj::INT + 35 * mp::INT + 45 * me::INT + 50 * mr::INT + 25 * j::INT + 10 * pt::INT + 8 * least(vc, 10) + 2 * least(ec, 20) + 4 * least(rc, 10) + least(refs, 50) + 4 * least(inf, 10) + 10 * oa::INT + 10 * ab::INT AS mapped_score,
  100 * (current_status = 'mapped')::INT + 80 * pmc::INT + 15 * loc::INT + 20 * oa::INT + 15 * ab::INT + 12 * mj::INT + 8 * mp::INT + 20 * me::INT + 25 * mr::INT + 4 * least(ec, 20) + 8 * least(rc, 10) + 4 * least(vc, 10) + 4 * least(inf, 10) AS evidence_score FROM base)
"""  # fmt: skip


def _mapped(spark: SparkSession, sf: str):
    """The phases of a run; each is written once and read by those that follow."""
    p, journals, patterns, annotations, aliases, terms = _inputs(spark, sf)
    admission = kept(selection.admission_signals(p, journals, patterns, annotations, aliases, terms), "admission")
    status = kept(selection.admitted(p, admission), "status")
    relations, metrics = s.relations(spark, sf), kept(merge.reference_metrics(s.citations(spark, sf)), "metrics")
    signals = kept(selection.mapped_signals(p, status, journals, patterns, annotations, relations, metrics), "promotion")
    final = kept(selection.promoted(p, status, signals), "final-status")
    return p, admission, signals, final, annotations, relations, metrics


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    p, admission, signals, final, annotations, relations, metrics = _mapped(spark, sf)
    return selection.selection_summary(p, final, admission.unionByName(selection.second_gate(signals, final)), annotations, relations, metrics)


@query(MAPPED + "SELECT corpus_id, signal_kind, family_key, match_value, signal_count, contributes_to_mapped FROM gated")
def sel_05(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of promotion, second gate applied (SEL-05, JON-12, JON-13)."""
    _, _, signals, final, *_ = _mapped(spark, sf)
    return selection.second_gate(signals, final).select("corpus_id", "signal_kind", "family_key", "match_value", "signal_count", "contributes_to_mapped")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


RULED = with_(PAPERS) + f""", er(i, concept, family_key, confidence) AS (VALUES {_values([(i, r[1], r[3], r[4]) for i, r in enumerate(codes.ENTITY_RULES)])}),
rr(i, object, family_key) AS (VALUES {_values([(i, r[3], r[5]) for i, r in enumerate(codes.RELATION_RULES)])}),
hits AS (
  SELECT corpus_id, 'mapped_entity_rule_match' AS signal_kind, family_key, concept AS match_value, confidence = 'high' AS contributes_to_mapped FROM events JOIN er ON i = event_id % 20 JOIN papers ON pmid = user_id
  UNION ALL SELECT corpus_id, 'mapped_relation_rule_match', family_key, object, true FROM lineitem JOIN rr ON i = (l_orderkey + l_linenumber) % 9 JOIN papers ON pmid = l_partkey)
SELECT corpus_id, signal_kind, family_key, match_value, count(*) AS signal_count, contributes_to_mapped FROM hits GROUP BY ALL"""


@query(RULED)
def sel_07(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of all sixteen entity rules and all seven relation rules: mentions and relations name the rules' concepts in turn, and others."""
    of = lambda rules, at: F.get(F.array(*(F.struct(*(F.lit(x) for x in r)) for r in rules)), at.cast("int"))
    p = s.papers(spark, sf)
    entity, relation = of([(r[0], r[1]) for r in codes.ENTITY_RULES], F.col("event_id") % 20), of([r[:4] for r in codes.RELATION_RULES], (F.col("l_orderkey") + F.col("l_linenumber")) % 9)
    mentions = table(spark, sf, "events").select(F.col("user_id").alias("pmid"), entity.alias("r")).select("pmid", F.col("r.col1").alias("entity_type"), F.col("r.col2").alias("concept_id_raw"))
    related = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pmid"), relation.alias("r")).select("pmid", F.col("r.col1").alias("subject_type"), F.col("r.col2").alias("relation_type"), F.col("r.col3").alias("object_type"), F.col("r.col4").alias("object_entity_id"))
    status = p.select("corpus_id", F.lit("corpus").alias("domain_status"))
    signals = selection.mapped_signals(p, status, s.journals(spark, sf).limit(0), s.venue_patterns(spark).limit(0), mentions, related, merge.reference_metrics(s.citations(spark, sf)))
    return signals.select("corpus_id", "signal_kind", "family_key", "match_value", "signal_count", "contributes_to_mapped")


@query(MAPPED + "SELECT * FROM final")
def sel_06(spark: SparkSession, sf: str) -> DataFrame:
    """Status after promotion."""
    return _mapped(spark, sf)[3]


@query(MAPPED + """SELECT corpus_id, current_status, primary_admission_reason, publication_year, families AS mapped_family_keys, vc AS vocab_entity_signal_count, mec AS mapped_entity_signal_count, mrc AS mapped_relation_signal_count, ec AS entity_annotation_count, rc AS relation_count,
refs AS reference_out_count, inf AS influential_reference_count, mapped_score AS mapped_priority_score, evidence_score AS evidence_priority_score FROM summary""")
def sel_08(spark: SparkSession, sf: str) -> DataFrame:
    """Summary and scores of every paper (SEL-08, AGG-16 to AGG-20, SCL-16, SCL-17, JON-18)."""
    df = _summary(spark, sf).withColumn("mapped_family_keys", F.array_join("mapped_family_keys", ","))
    return df.select("corpus_id", "current_status", "primary_admission_reason", "publication_year", "mapped_family_keys", "vocab_entity_signal_count", "mapped_entity_signal_count", "mapped_relation_signal_count", "entity_annotation_count", "relation_count", "reference_out_count", "influential_reference_count", "mapped_priority_score", "evidence_priority_score")


WAVE = """SELECT corpus_id, row_number() OVER (ORDER BY evidence_score DESC, mapped_score DESC, mrc DESC, mec DESC, vc DESC, ec DESC, refs DESC, corpus_id) AS member_ordinal, evidence_score AS priority_score FROM summary
WHERE current_status = 'mapped' AND (publication_year IS NULL OR publication_year >= 1960) AND evidence_score >= 150 AND loc AND corpus_id NOT IN (SELECT corpus_id FROM papers WHERE title LIKE 'red%')"""


def _wave(spark: SparkSession, sf: str, most: int | None) -> DataFrame:
    return selection.wave(_summary(spark, sf), s.papers(spark, sf).filter("title like 'red%'"), 1960, max_papers=most)


@query(MAPPED + WAVE)
def sel_11(spark: SparkSession, sf: str) -> DataFrame:
    """The wave of all papers, ranked (SEL-11, WIN-06)."""
    return _wave(spark, sf, None)


@query(MAPPED + WAVE + " QUALIFY member_ordinal <= 25")
def tbl_09(spark: SparkSession, sf: str) -> DataFrame:
    """The first members of a wave."""
    return _wave(spark, sf, 25)


@query(MAPPED + "SELECT count(*) AS papers, count(*) FILTER (WHERE domain_status = 'mapped') AS mapped_papers, count(*) FILTER (WHERE domain_status = 'corpus') AS corpus_papers, count(*) FILTER (WHERE domain_status = 'retired') AS retired_papers, (SELECT count(*) FROM signals) AS corpus_admission_signals, (SELECT count(*) FROM gated) AS mapped_promotion_signals FROM final")
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of a run (AGG-21, JON-23)."""
    _, admission, signals, final, *_ = _mapped(spark, sf)
    return selection.counters(final, admission.unionByName(signals))


# ---------------------------------------------------------------- texts and retrieval


@query("""SELECT doc_id, text_availability, has_document, 0 + block_count AS block_count, has_document AND block_count = 0 AS document_without_blocks, NOT has_document AND block_count > 0 AS blocks_without_document, text_availability >= 2 AND NOT has_document AS stated_but_missing
FROM (SELECT d.doc_id, CASE WHEN n_chars > 2000 THEN 2 ELSE 1 END AS text_availability, l.doc_id IS NOT NULL AS has_document, coalesce(q.n, 0) AS block_count FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1) q USING (doc_id))""")
def doc_04(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose parts contradict each other (DOC-04, JON-24)."""
    texts = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, 2).otherwise(1).alias("text_availability"))
    labels = table(spark, sf, "labels")
    return docs.contract_audit(texts, labels, labels.filter("quality = 1"), "doc_id")


@query(r"""WITH l AS (SELECT doc_id AS corpus_id, i - 1 AS block_ordinal, x[i] AS t FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)) WHERE trim(x[i], ' ') <> ''),
p AS (SELECT *, length(regexp_extract(t, '^[.!?]*')) AS lead FROM l),
q AS (SELECT *, regexp_extract_all(substr(t, lead + 1), '[^.!?]+[.!?]*') AS pieces FROM p),
w AS (SELECT *, list_transform(pieces, lambda x: length(x)) AS sizes, list_transform(pieces, lambda x: regexp_extract(x, '[^.!?]+[.!?]?')) AS bodies FROM q),
k AS (SELECT corpus_id, block_ordinal, t, lead, sizes, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM w WHERE len(list_filter(bodies, lambda x: trim(x, ' ') <> '')) > 0),
s AS (SELECT corpus_id, block_ordinal, lead + coalesce(list_sum(sizes[1:i - 1]), 0) AS start_offset, bodies[i] AS body FROM k WHERE trim(bodies[i], ' ') <> '' UNION ALL SELECT corpus_id, block_ordinal, 0, t FROM w WHERE len(list_filter(bodies, lambda x: trim(x, ' ') <> '')) = 0)
SELECT corpus_id, block_ordinal, row_number() OVER (PARTITION BY corpus_id, block_ordinal ORDER BY start_offset) - 1 AS sentence_ordinal, start_offset::BIGINT AS start_offset, (start_offset + length(body))::BIGINT AS end_offset, trim(body, ' ') AS text FROM s""")
def doc_01(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all documents, lines as paragraphs (DOC-01, JON-21, SCL-11)."""
    rows = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("corpus_id"), F.posexplode(F.split("text", "\n")).alias("block_ordinal", "text"))
    blocks = rows.filter(F.trim("text") != "").withColumns({"section_ordinal": F.lit(0), "start_offset": F.lit(0)})
    return docs.block_sentences(blocks).select("corpus_id", "block_ordinal", "sentence_ordinal", "start_offset", "end_offset", "text")


CHUNKS = r"""WITH RECURSIVE b AS (SELECT doc_id AS corpus_id, i - 1 AS n, len(list_filter(regexp_split_to_array(x[i], '\s+'), lambda w: w <> '')) AS words FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
step AS (SELECT corpus_id, n, words AS held, 0 AS chunk_ordinal, 0 AS first_block FROM b WHERE n = 0
  UNION ALL SELECT b.corpus_id, b.n, CASE WHEN held >= 256 OR held + b.words > 384 THEN b.words ELSE held + b.words END, chunk_ordinal + (held >= 256 OR held + b.words > 384)::INT, CASE WHEN held >= 256 OR held + b.words > 384 THEN b.n ELSE first_block END FROM step JOIN b ON b.corpus_id = step.corpus_id AND b.n = step.n + 1)
SELECT corpus_id, chunk_ordinal::BIGINT AS chunk_ordinal, min(first_block)::BIGINT AS first_block, max(held)::BIGINT AS words FROM step GROUP BY corpus_id, chunk_ordinal"""


@query(CHUNKS)
def doc_05(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, lines as blocks."""
    rows = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("corpus_id"), F.posexplode(F.split("text", "\n")).alias("block_ordinal", "text"))
    return docs.chunks(rows.withColumn("section_ordinal", F.lit(0))).select("corpus_id", "chunk_ordinal", "first_block", "words")


_TOKENS = r"len(regexp_extract_all({0}, '\p{{L}}+|\p{{N}}+|[^\s\p{{L}}\p{{N}}]'))"
TOKEN_CHUNKS = rf"""WITH RECURSIVE lines AS (SELECT doc_id AS corpus_id, i - 1 AS block, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
b AS (SELECT *, {_TOKENS.format('text')} AS tokens FROM lines),
sentences AS (SELECT corpus_id, block, i AS s, x[i] AS text, {_TOKENS.format('x[i]')} AS tokens FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT corpus_id, block, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM b WHERE tokens > 384))),
runs AS (SELECT corpus_id, block, s, unnest(range(0, (tokens + 383) // 384)) AS j, tokens FROM sentences WHERE tokens > 384),
p AS (SELECT corpus_id, block, 0 AS s, 0 AS j, tokens, tokens < 8 AS attached FROM b WHERE tokens BETWEEN 1 AND 384
  UNION ALL SELECT s.corpus_id, s.block, s.s, 0, s.tokens, false FROM sentences s WHERE s.tokens BETWEEN 1 AND 384
  UNION ALL SELECT corpus_id, block, s, j, least(384, tokens - 384 * j), false FROM runs),
n AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY block, s, j) AS pos FROM p),
step AS (SELECT corpus_id, pos, tokens AS held, 0 AS chunk, block AS first_block, block AS last_block FROM n WHERE pos = 1
  UNION ALL SELECT n.corpus_id, n.pos, CASE WHEN held + n.tokens > 384 OR (held >= 256 AND NOT n.attached) THEN n.tokens ELSE held + n.tokens END, chunk + (held + n.tokens > 384 OR (held >= 256 AND NOT n.attached))::INT,
    CASE WHEN held + n.tokens > 384 OR (held >= 256 AND NOT n.attached) THEN n.block ELSE first_block END, n.block FROM step JOIN n ON n.corpus_id = step.corpus_id AND n.pos = step.pos + 1)
SELECT corpus_id, chunk::BIGINT AS chunk_ordinal, min(first_block)::BIGINT AS first_block, max(last_block)::BIGINT AS last_block, max(held)::BIGINT AS tokens FROM step GROUP BY corpus_id, chunk"""


@query(TOKEN_CHUNKS)
def doc_05_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents by tokens: lines as blocks, short ones as captions, long ones cut."""
    rows = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("corpus_id"), F.posexplode(F.split("text", "\n")).alias("block_ordinal", "text"))
    kind = F.when(docs.token_count(F.col("text")) < 8, "figure_caption").otherwise("narrative_paragraph")
    made = docs.token_chunks(rows.withColumns({"section_ordinal": F.lit(0), "block_kind": kind}))
    return made.select("corpus_id", "chunk_ordinal", "first_block", "last_block", "tokens")


VECTORS = """norms AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cosines AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM norms q JOIN norms c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)"""


def _nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.nearest(vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query("WITH " + VECTORS + " SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cosines QUALIFY rank <= 20")
def ret_06(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors of a stated query set (RET-02, RET-06)."""
    return _nearest(spark, sf, 20).withColumn("score", F.round("score", 6))


def _bm25_sql() -> str:
    words = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    parts = []
    for field, weight in (("text", 1.0), ("source", 0.5)):
        terms = [f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(2)]
        parts.append(f"""SELECT doc_id, {weight} * ({' + '.join(terms)}) AS part FROM (SELECT doc_id, len(w) AS size, len(list_filter(w, lambda x: x = 'the')) AS tf0, len(list_filter(w, lambda x: x = 'web')) AS tf1 FROM (SELECT doc_id, {words.format(field)} AS w FROM documents)) a,
(SELECT count(*) AS n, avg(len(w)) AS mean, count(*) FILTER (WHERE list_contains(w, 'the')) AS df0, count(*) FILTER (WHERE list_contains(w, 'web')) AS df1 FROM (SELECT {words.format(field)} AS w FROM documents)) b WHERE tf0 > 0 OR tf1 > 0""")
    return "SELECT doc_id, round(sum(part), 6) AS score FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id"


@query(_bm25_sql())
def ret_01(spark: SparkSession, sf: str) -> DataFrame:
    """Word scores over two fields."""
    return retrieval.bm25(table(spark, sf, "documents"), ["The", "web"], {"text": 1.0, "source": 0.5}, "doc_id").withColumn("score", F.round("score", 6))


@query("""WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 200), b AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY max(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey QUALIFY rank <= 200)
SELECT id, round(sum(1 / (60 + rank)), 8) AS score, count(*) AS channels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def ret_03(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels fused by rank."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("score"))
    return retrieval.fused([retrieval.ranked(a, [], 200), retrieval.ranked(b, [], 200)]).withColumn("score", F.round("score", 8))


@query("""WITH a AS (SELECT c_custkey AS id, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS s FROM customer), o AS (SELECT o_custkey AS id, max(o_totalprice) AS m FROM orders GROUP BY 1), b AS (SELECT id, (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()) AS s FROM o)
SELECT id, round((coalesce(a.s, 0) + coalesce(b.s, 0)) / 2, 8) AS score FROM a FULL OUTER JOIN b USING (id)""")
def ret_04(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels scaled and averaged."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("score"))
    return retrieval.mean_of(a, b).withColumn("score", F.round("score", 8))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders QUALIFY n <= 3)
SELECT o_custkey, max(o_totalprice) AS score, array_to_string(list(o_orderkey ORDER BY n), ',') AS chunks FROM r GROUP BY o_custkey ORDER BY score DESC, o_custkey LIMIT 30""")
def ret_05(spark: SparkSession, sf: str) -> DataFrame:
    """Parents by their best chunk."""
    chunks = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return retrieval.promoted(chunks, "o_custkey", 30, key="o_orderkey").withColumn("chunks", F.array_join("chunks", ","))


@query("SELECT DISTINCT 'n' || (o_custkey % 25) AS linked_from, 'n' || (o_orderkey % 25) AS slug FROM orders")
def ret_13(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that link to a page."""
    page = F.concat(F.lit("n"), F.col("o_custkey") % 25)
    pages = table(spark, sf, "orders").groupBy(page.alias("slug")).agg(F.collect_set(F.concat(F.lit("n"), F.col("o_orderkey") % 25)).alias("links"))
    return retrieval.backlinks(pages).distinct()


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf: str, per_trigger: int = 100) -> DataFrame:
    return ingest.files(spark, sf, table(spark, sf, "events").schema, "events.parquet", per_trigger=per_trigger)


@query("SELECT user_id, max(event_id) AS event_id, count(*) > 0 AS seen FROM events GROUP BY user_id")
def str_04(spark: SparkSession, sf: str) -> DataFrame:
    """Files loaded as they come, the last row of each key kept (STR-01, STR-03, STR-04)."""
    path = scratch(spark, "ingest")

    def latest(batch: DataFrame, number: int) -> None:
        first = merge.first_of(batch.select("user_id", "event_id"), ["user_id"], [F.desc("event_id")])
        ingest.appending(f"{path}/rows")(first, number)

    ingest.load(_stream(spark, sf), f"{path}/checkpoint", latest).awaitTermination()
    return ingest.current(spark, f"{path}/rows", ["user_id"]).select("user_id", "event_id", F.lit(True).alias("seen"))


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL")
def str_06(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day and kind over a stream (an extension: windows with a watermark)."""
    path = scratch(spark, "windows")
    counted = ingest.tumbling(_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", ["event_type"])
    shaped = counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "count")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
    shaped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return merge.first_of(rows, ["day", "event_type"], [F.desc("batch")]).drop("batch")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def str_04_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Eight files merged as eight batches into a keyed table whose deltas are folded as they grow (STR-04)."""
    folder, rows = scratch(spark, "batches"), table(spark, sf, "events").select("user_id", "event_id")
    rows.repartition(8, "event_id").write.parquet(f"{folder}/in")
    keyed = ingest.KeyedTable(spark, f"{folder}/table", ["user_id"], ["event_id"], rows.schema)
    ingest.load(ingest.files(spark, f"{folder}/in", rows.schema, per_trigger=1), f"{folder}/checkpoint", keyed.merge).awaitTermination()
    return keyed.current()


@query("SELECT c_custkey, c_name, c_acctbal, true AS pinned, true AS refused, true AS rolled_back FROM customer")
def snk_15(spark: SparkSession, sf: str) -> DataFrame:
    """A table published behind a pointer: a second version is seen, one without its columns is refused, a reader stays
    with its version, and after a rollback the first is read again (SNK-14, SNK-15)."""
    table_, rows = ledger.Published(spark, scratch(spark, "published")), table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    first = table_.publish(rows)
    reader = table_.read()
    second = table_.publish(rows.filter("c_acctbal > 0"), expected=first)
    fewer = table_.read()
    try:
        table_.publish(rows.drop("c_name"))
        refused = False
    except ledger.Rejected:
        refused = True
    pinned = reader.count() == rows.count() and fewer.count() == rows.filter("c_acctbal > 0").count() and table_.state()["version"] == second
    back = table_.rollback() == first
    return table_.read().select("*", F.lit(pinned).alias("pinned"), F.lit(refused).alias("refused"), F.lit(back).alias("rolled_back"))
