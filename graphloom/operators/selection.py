"""The rule-based selection of papers: admission, promotion, summary, scores and ranked waves.

The stages are pure derivations: signals are rows, statuses are rolled up from them. Curated
tables (journal names, patterns, rules, aliases) are bounded by what people maintain by hand and
are broadcast; papers, annotations and relations are shuffled by their keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import codes
from graphloom.functions.text import clean_venue, lookup_key, short_digest, with_pmc_prefix
from graphloom.operators.views import numbered

SIGNAL = ["corpus_id", "phase_name", "signal_kind", "family_key", "match_key", "match_value", "signal_count", "contributes_to_corpus", "contributes_to_mapped", "confidence"]
MIN_YEAR, LOOKBACK, LEAST_SCORE = 1945, 10, 150
#: Curated rows up to which a table is broadcast, and patterns, each of which every venue is held against.
MOST_CURATED, MOST_PATTERNS = 2_000_000, 10_000


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.VENUE_PATTERNS, codes.PATTERN_SCHEMA)


def entity_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.ENTITY_RULES, codes.ENTITY_RULE_SCHEMA)


def relation_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(codes.RELATION_RULES, codes.RELATION_RULE_SCHEMA)


def curated(rows: DataFrame) -> DataFrame:
    """Broadcast if the table is as small as curated tables are."""
    return F.broadcast(rows) if rows.limit(MOST_CURATED + 1).count() <= MOST_CURATED else rows


def with_venue(papers: DataFrame) -> DataFrame:
    return papers.withColumn("normalized_venue", F.coalesce(clean_venue(F.col("venue_raw")), F.lit("")))


def _signals(rows: DataFrame, phase: str, kind: str, **columns: Column) -> DataFrame:
    found = {"phase_name": F.lit(phase), "signal_kind": F.lit(kind), "signal_count": F.lit(1).cast("long"), "contributes_to_corpus": F.lit(False), "contributes_to_mapped": F.lit(False), "confidence": F.lit(None).cast("string"), **columns}
    return rows.select("corpus_id", *(found[c].alias(c) for c in SIGNAL[1:]))


def by_journal(papers: DataFrame, journals: DataFrame, phase: str, kind: str) -> DataFrame:
    hits = with_venue(papers).join(curated(journals.select("normalized_venue").distinct()), "normalized_venue")
    to = "contributes_to_corpus" if phase == "corpus_admission" else "contributes_to_mapped"
    return _signals(hits, phase, kind, family_key=F.lit("journal_inventory"), match_key=F.lit("normalized_venue"), match_value=F.col("normalized_venue"), **{to: F.lit(True)})


def by_pattern(papers: DataFrame, rules: DataFrame, phase: str, kind: str) -> DataFrame:
    """A paper that matches several patterns gives as many signals; patterns are maintained by hand and few."""
    if rules.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    hits = with_venue(papers).join(F.broadcast(rules), F.expr("normalized_venue LIKE like_pattern"))
    to = "contributes_to_corpus" if phase == "corpus_admission" else "contributes_to_mapped"
    return _signals(hits, phase, kind, family_key=F.col("pattern_key"), match_key=F.lit("like_pattern"), match_value=F.col("like_pattern"), **{to: F.lit(True)})


def alias_hits(papers: DataFrame, annotations: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """corpus_id, term and how often its aliases are mentioned; the alias named is a preferred one."""
    named = curated(aliases.select("term_id", "alias", "is_preferred", "normalized_alias").join(terms.select("term_id", "canonical_name", "category"), "term_id"))
    mentions = annotations.withColumn("normalized_alias", lookup_key(F.col("mention_text"))).join(named, "normalized_alias")
    hits = mentions.join(papers.filter("pmid is not null").select("corpus_id", "pmid"), "pmid")
    preferred = F.min(F.when(F.col("is_preferred"), F.col("alias")))
    return hits.groupBy("corpus_id", "term_id", "canonical_name", "category").agg(F.coalesce(preferred, F.min("alias")).alias("matched_alias"), F.count("*").alias("signal_count"))


def admission_signals(papers: DataFrame, journals: DataFrame, rules: DataFrame, annotations: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    phase = "corpus_admission"
    vocabulary = _signals(alias_hits(papers, annotations, aliases, terms), phase, "vocab_entity_match", family_key=F.lit("vocab_alias"), match_key=F.lit("term_id"), match_value=F.col("term_id").cast("string"), signal_count=F.col("signal_count"), contributes_to_corpus=F.lit(True))
    return by_journal(papers, journals, phase, "journal_match").unionByName(by_pattern(papers, rules, phase, "pattern_match")).unionByName(vocabulary)


def any_of(kind: str, *more: Column) -> Column:
    """Whether a group has a signal of a kind."""
    test = F.col("signal_kind") == kind
    for m in more:
        test = test & m
    return F.coalesce(F.bool_or(test), F.lit(False))


def admitted(papers: DataFrame, signals: DataFrame) -> DataFrame:
    """corpus_id, domain_status, admission_reason of every paper with a corpus id."""
    rolled = signals.groupBy("corpus_id").agg(any_of("journal_match").alias("j"), any_of("pattern_match").alias("p"), any_of("vocab_entity_match").alias("v"))
    all_ = papers.filter("corpus_id is not null").select("corpus_id").join(rolled, "corpus_id", "left").na.fill(False, ["j", "p", "v"])
    reason = F.when(F.col("j") & F.col("v"), "journal_and_vocab").when(F.col("j"), "journal_match").when(F.col("p"), "pattern_match").when(F.col("v"), "vocab_entity_match").otherwise("selection_retired")
    return all_.select("corpus_id", F.when(reason == "selection_retired", "retired").otherwise("corpus").alias("domain_status"), reason.alias("admission_reason"))


def resolved_ids(hits: DataFrame, papers: DataFrame, known: DataFrame) -> DataFrame:
    """paper_id and corpus_id of each hit: by its own id, PubMed, DOI or PMC in ``known``, else new.

    Identifiers are unique in ``known``. New ids follow the largest, in order of paper_id.
    """
    rows = papers.join(hits.select("paper_id").distinct(), "paper_id", "left_semi").withColumn("_pmc", with_pmc_prefix(F.col("pmc_id")))
    for here, there in (("paper_id", "s2_paper_id"), ("pmid", "pmid"), ("doi_norm", "doi_norm"), ("_pmc", "pmc_id")):
        rows = rows.join(known.filter(F.col(there).isNotNull()).select(F.col(there).alias(here), F.col("corpus_id").alias(f"_by_{here}")), here, "left")
    own = rows.withColumn("corpus_id", F.coalesce("_by_paper_id", "_by_pmid", "_by_doi_norm", "_by__pmc", "corpus_id")).select("paper_id", "corpus_id")
    last = known.agg(F.coalesce(F.max("corpus_id"), F.lit(0))).first()[0]
    new = numbered(own.filter("corpus_id is null").select("paper_id"), [F.length("paper_id").asc(), F.asc("paper_id")], last + 1, "corpus_id")
    return own.filter("corpus_id is not null").unionByName(new.select("paper_id", "corpus_id"))


def mapped_signals(papers: DataFrame, status: DataFrame, journals: DataFrame, rules: DataFrame, annotations: DataFrame, relations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Signals that promote papers of status ``corpus``: journals, patterns, entity and relation rules."""
    spark, phase = papers.sparkSession, "mapped_promotion"
    scope = papers.join(status.filter("domain_status = 'corpus'").select("corpus_id"), "corpus_id", "left_semi")
    references = metrics.withColumnRenamed("citing_paper_id", "paper_id").join(scope.select("paper_id", "corpus_id"), "paper_id").groupBy("corpus_id").agg(F.sum("reference_out_count").alias("refs"))
    own = scope.filter("pmid is not null").select("corpus_id", "pmid")
    refs = F.coalesce("refs", F.lit(0))
    entities = annotations.join(F.broadcast(entity_rules(spark)), ["entity_type", "concept_id_raw"]).join(own, "pmid")
    entities = entities.groupBy("corpus_id", "concept_id_raw", "family_key", "confidence", "min_reference_count").agg(F.count("*").alias("signal_count")).join(references, "corpus_id", "left")
    direct = F.col("confidence").isin(*codes.DIRECT_CONFIDENCES) & (refs >= F.col("min_reference_count"))
    by_entity = _signals(entities, phase, "mapped_entity_rule_match", family_key=F.col("family_key"), match_key=F.lit("concept_id_raw"), match_value=F.col("concept_id_raw"), signal_count=F.col("signal_count"), contributes_to_mapped=direct, confidence=F.col("confidence"))
    keyed = relations.withColumnRenamed("object_entity_id", "object_id_raw")
    found = keyed.join(F.broadcast(relation_rules(spark)), ["subject_type", "relation_type", "object_type", "object_id_raw"]).join(own, "pmid")
    # A relation that both sources have counts twice.
    found = found.groupBy("corpus_id", "object_id_raw", "family_key", "min_reference_count").agg(F.count("*").alias("signal_count")).join(references, "corpus_id", "left")
    by_relation = _signals(found, phase, "mapped_relation_rule_match", family_key=F.col("family_key"), match_key=F.lit("object_id_raw"), match_value=F.col("object_id_raw"), signal_count=F.col("signal_count"), contributes_to_mapped=refs >= F.col("min_reference_count"))
    venues = by_journal(scope, journals, phase, "mapped_journal_match").unionByName(by_pattern(scope, rules.filter("promotes_to_mapped"), phase, "mapped_pattern_match"))
    return venues.unionByName(by_entity).unionByName(by_relation)


def promoted(papers: DataFrame, status: DataFrame, signals: DataFrame, min_year: int = MIN_YEAR) -> DataFrame:
    """``status`` with those mapped that have a contributing signal and are new enough."""
    counts = F.col("contributes_to_mapped")
    entity = counts & F.col("confidence").isin(*codes.DIRECT_CONFIDENCES)
    rolled = signals.groupBy("corpus_id").agg(
        (any_of("mapped_journal_match", counts) | any_of("mapped_pattern_match", counts) | any_of("mapped_entity_rule_match", entity) | any_of("mapped_relation_rule_match", counts)).alias("direct")
    )
    rows = status.join(papers.select("corpus_id", "year"), "corpus_id").join(rolled, "corpus_id", "left")
    new_enough = F.col("year").isNull() | (F.col("year") >= min_year)
    mapped = (F.col("domain_status") != "retired") & new_enough & F.coalesce("direct", F.lit(False))
    return rows.select("corpus_id", F.when(mapped, "mapped").otherwise(F.col("domain_status")).alias("domain_status"), "admission_reason")


def second_gate(signals: DataFrame, status: DataFrame) -> DataFrame:
    """Signals in which second-gate rules contribute just for papers that are mapped."""
    mapped = status.select("corpus_id", (F.col("domain_status") == "mapped").alias("_mapped"))
    gated = (F.col("signal_kind") == "mapped_entity_rule_match") & F.col("confidence").isin(*codes.SECOND_GATE)
    return signals.join(mapped, "corpus_id", "left").withColumn("contributes_to_mapped", F.when(gated, F.coalesce("_mapped", F.lit(False))).otherwise(F.col("contributes_to_mapped"))).select(*SIGNAL)


def mapped_priority() -> Column:
    return (
        F.when(F.col("current_status") == "mapped", 100).otherwise(0)
        + sum((F.when(F.col(c), n).otherwise(0) for c, n in (("has_mapped_journal_match", 60), ("has_mapped_pattern_match", 35), ("has_mapped_entity_match", 45), ("has_mapped_relation_match", 50), ("has_journal_match", 25), ("has_pattern_match", 10), ("has_open_access", 10), ("has_abstract", 10))), F.lit(0))
        + sum((F.least(F.col(c), F.lit(most)) * n for c, most, n in (("vocab_entity_signal_count", 10, 8), ("entity_annotation_count", 20, 2), ("relation_count", 10, 4), ("reference_out_count", 50, 1), ("influential_reference_count", 10, 4))), F.lit(0))
    ).cast("int")


def evidence_priority() -> Column:
    return (
        F.when(F.col("current_status") == "mapped", 100).otherwise(0)
        + sum((F.when(F.col(c), n).otherwise(0) for c, n in (("has_pmc_id", 80), ("has_locator_candidate", 15), ("has_open_access", 20), ("has_abstract", 15), ("has_mapped_journal_match", 12), ("has_mapped_pattern_match", 8), ("has_mapped_entity_match", 20), ("has_mapped_relation_match", 25))), F.lit(0))
        + sum((F.least(F.col(c), F.lit(most)) * n for c, most, n in (("entity_annotation_count", 20, 4), ("relation_count", 10, 8), ("vocab_entity_signal_count", 10, 4), ("influential_reference_count", 10, 4))), F.lit(0))
    ).cast("int")


def selection_summary(papers: DataFrame, status: DataFrame, signals: DataFrame, annotations: DataFrame, relations: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row for each paper with a corpus id: status, flags, counts and both priority scores."""
    kind, counts = F.col("signal_kind"), F.coalesce("contributes_to_mapped", F.lit(False))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("signal_count"))), F.lit(0))
    rolled = signals.groupBy("corpus_id").agg(
        any_of("journal_match").alias("has_journal_match"), any_of("pattern_match").alias("has_pattern_match"), any_of("vocab_entity_match").alias("has_vocab_entity_match"),
        any_of("mapped_journal_match", counts).alias("has_mapped_journal_match"), any_of("mapped_pattern_match", counts).alias("has_mapped_pattern_match"),
        any_of("mapped_entity_rule_match", counts).alias("has_mapped_entity_match"), any_of("mapped_relation_rule_match", counts).alias("has_mapped_relation_match"),
        total(kind == "journal_match").alias("journal_signal_count"), total(kind == "pattern_match").alias("pattern_signal_count"), total(kind == "vocab_entity_match").alias("vocab_entity_signal_count"),
        total(counts).alias("mapped_signal_count"), total(counts & (kind == "mapped_entity_rule_match")).alias("mapped_entity_signal_count"), total(counts & (kind == "mapped_relation_rule_match")).alias("mapped_relation_signal_count"),
        F.array_sort(F.collect_set(F.when(counts, F.col("family_key")))).alias("mapped_family_keys"),
    )
    scope = with_venue(papers.filter("corpus_id is not null")).select(
        "corpus_id", "paper_id", "pmid", "normalized_venue", F.col("year").try_cast("smallint").alias("publication_year"), F.coalesce("is_open_access", F.lit(False)).alias("has_open_access"), F.col("pmc_id").isNotNull().alias("has_pmc_id"),
        (F.col("pmc_id").isNotNull() | F.col("pmid").isNotNull() | F.col("doi_norm").isNotNull()).alias("has_locator_candidate"), F.col("abstract").isNotNull().alias("has_abstract"),
    )
    ids = scope.select("corpus_id", "pmid").filter("pmid is not null")
    per = lambda rows, name: rows.select("pmid").join(ids, "pmid").groupBy("corpus_id").agg(F.count("*").alias(name))
    references = metrics.withColumnRenamed("citing_paper_id", "paper_id").join(scope.select("paper_id", "corpus_id"), "paper_id").groupBy("corpus_id").agg(F.sum("reference_out_count").alias("reference_out_count"), F.sum("influential_reference_count").alias("influential_reference_count"))
    out = scope.join(status.select("corpus_id", F.col("domain_status").alias("current_status"), F.col("admission_reason").alias("primary_admission_reason")), "corpus_id")
    for more in (rolled, per(annotations, "entity_annotation_count"), per(relations, "relation_count"), references):
        out = out.join(more, "corpus_id", "left")
    flags = [c for c in rolled.columns if c.startswith("has_")]
    numbers = [c for c in out.columns if c.endswith("_count")]
    out = out.na.fill(False, flags).na.fill(0, numbers).withColumn("mapped_family_keys", F.coalesce("mapped_family_keys", F.array().cast("array<string>")))
    return out.withColumns({"mapped_priority_score": mapped_priority(), "evidence_priority_score": evidence_priority()})


def wave(summary: DataFrame, documents: DataFrame, year_floor: int, least_score: int = LEAST_SCORE, need_locator: bool = True, max_papers: int | None = None) -> DataFrame:
    """corpus_id, member_ordinal, priority_score of mapped papers without a document, best first.

    ``documents`` holds the corpus ids that have one of the wanted kind.
    """
    rows = summary.filter("current_status = 'mapped'").filter(F.col("publication_year").isNull() | (F.col("publication_year") >= year_floor)).filter(F.col("evidence_priority_score") >= least_score)
    if need_locator:
        rows = rows.filter("has_locator_candidate")
    rows = rows.join(documents.select("corpus_id"), "corpus_id", "left_anti")
    order = [F.desc(c) for c in ("evidence_priority_score", "mapped_priority_score", "mapped_relation_signal_count", "mapped_entity_signal_count", "vocab_entity_signal_count", "entity_annotation_count", "reference_out_count")] + [F.asc("corpus_id")]
    if max_papers is not None:
        # The best few only: a distributed top-k before they are numbered.
        rows = rows.orderBy(*order).limit(max_papers)
        ranked = rows.withColumn("member_ordinal", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = numbered(rows, order, 1, "member_ordinal")
    return ranked.select("corpus_id", F.col("member_ordinal").cast("long").alias("member_ordinal"), F.col("evidence_priority_score").alias("priority_score"))


def drained(members: DataFrame, sent: DataFrame, size: int) -> DataFrame:
    """The next members that were not sent yet, in order."""
    return members.join(sent.select("corpus_id"), "corpus_id", "left_anti").orderBy("member_ordinal").limit(size)


def counters(status: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: papers by status and signals by phase."""
    by_status = status.agg(F.count("*").alias("papers"), *(F.count_if(F.col("domain_status") == s).alias(f"{s}_papers") for s in ("mapped", "corpus", "retired")))
    by_phase = signals.agg(*(F.count_if(F.col("phase_name") == p).alias(f"{p}_signals") for p in ("corpus_admission", "mapped_promotion")))
    return by_status.crossJoin(F.broadcast(by_phase))


def domain_score(points: DataFrame, year: int, journals: list[str]) -> DataFrame:
    """Points with a score of diversity, references, recency and journal, best first."""
    fields = F.size(F.filter(F.split(F.coalesce("semantic_groups", F.lit("")), ","), lambda x: F.trim(x) != "")).cast("double")
    recency = F.greatest(F.lit(0.0), 1 - (F.lit(year) - F.col("year")) / 50)
    weight = F.when(F.lower("journal").isin(journals), 1.5).otherwise(1.0)
    return points.withColumn("domain_score", (fields * fields + F.log1p(F.coalesce("paper_reference_count", F.lit(0))) + F.coalesce(recency, F.lit(0.0))) * weight)


def year_floor(year: int, lookback: int = LOOKBACK) -> int:
    """The first year that a wave takes in; the present year is given, so that runs can be repeated."""
    return year - lookback


def materialised(papers: DataFrame, status: DataFrame, venues: DataFrame, paper_authors: DataFrame, authors: DataFrame, annotations: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The canonical tables of a release: papers and paper_text of all that were admitted; of mapped papers
    authors, paper_authors, entity_annotations and relations.

    A paper's venue is that of its source id, else of its name, else none. Authors of the batch replace the
    stored name of their source id; one without a source id is found by name, or new. Annotations and
    relations are unique by their key (the last by mention, or by end types, stays); only the first
    source of relations counts.
    """
    of = status.filter(F.col("domain_status").isin("corpus", "mapped")).select("corpus_id", "domain_status")
    admitted_ = papers.filter("corpus_id is not null").join(of, "corpus_id")
    mapped = admitted_.filter("domain_status = 'mapped'").select("corpus_id", "paper_id")
    named = admitted_.withColumn("_name", lookup_key(F.col("venue_raw")))
    by_id = venues.filter("source_venue_id is not null").groupBy("source_venue_id").agg(F.min("venue_id").alias("_by_id"))
    by_name = venues.select(lookup_key(F.col("name")).alias("_name"), "venue_id").filter("_name is not null").groupBy("_name").agg(F.min("venue_id").alias("_by_name"))
    found = named.join(by_id, "source_venue_id", "left").join(by_name, "_name", "left")
    out = {"papers": found.select("corpus_id", F.coalesce("_by_id", "_by_name").alias("venue_id"), F.col("year").try_cast("smallint").alias("year"), "is_open_access", "pmid", "doi_norm", "pmc_id", F.col("paper_id").alias("s2_paper_id"))}
    out["paper_text"] = admitted_.select(
        "corpus_id", short_digest(F.coalesce("title", F.lit(""))).alias("title_hash"), short_digest(F.col("abstract")).alias("abstract_hash"),
        F.when(F.col("abstract").isNotNull(), 1).otherwise(0).alias("text_availability"), F.coalesce("title", F.lit("")).alias("title"), "abstract",
    )
    raw = paper_authors.join(mapped, "paper_id")
    fresh = raw.filter("source_author_id is not null").groupBy("source_author_id").agg(F.max("name_raw").alias("name"))
    stored = authors.filter("source_author_id is not null").join(fresh, "source_author_id", "full_outer").select("source_author_id", F.coalesce("name", "display_name").alias("display_name"))
    nameless = authors.filter("source_author_id is null").select("display_name")
    known = stored.select(lookup_key(F.col("display_name")).alias("_name")).union(nameless.select(lookup_key(F.col("display_name")))).distinct()
    missing = raw.filter("source_author_id is null").select(F.col("name_raw").alias("display_name")).distinct().withColumn("_name", lookup_key(F.col("display_name"))).join(known, "_name", "left_anti").select("display_name")
    none = F.lit(None).cast("string").alias("source_author_id")
    out["authors"] = stored.unionByName(nameless.select(none, "display_name")).unionByName(missing.select(none, "display_name"))
    # One name may be several authors'; each of them is the author then.
    all_ = out["authors"].withColumn("_name", lookup_key(F.col("display_name")))
    direct = raw.filter("source_author_id is not null").join(all_.drop("_name"), "source_author_id")
    named_ = raw.filter("source_author_id is null").drop("source_author_id").withColumn("_name", lookup_key(F.col("name_raw"))).join(all_, "_name")
    columns = ["corpus_id", "author_ordinal", "source_author_id", "display_name"]
    out["paper_authors"] = direct.select(*columns).unionByName(named_.select(*columns))
    ids = papers.filter("pmid is not null").select("pmid", "paper_id").join(mapped, "paper_id").select("pmid", "corpus_id")
    keys = ["corpus_id", "start_offset", "end_offset", "entity_type", "concept_id_raw", "resource"]
    out["entity_annotations"] = annotations.join(ids, "pmid").groupBy(*keys).agg(F.max("mention_text").alias("mention_text"))
    keys = ["corpus_id", "subject_entity_id", "relation_type", "object_entity_id"]
    out["relations"] = relations.filter("relation_source = 1").join(ids, "pmid").groupBy(*keys).agg(F.max("subject_type").alias("subject_type"), F.max("object_type").alias("object_type"))
    return out
