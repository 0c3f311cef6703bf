"""Annotated documents in BioC XML: entities and relations of a release, read natively.

``document`` elements become rows by Spark's XML functions. Archives are read as streams of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.codes import ENTITY_TYPES, FROM_XML, RELATION_TYPES, code_of, entity_type_of, relation_name
from graphloom.sources.files import kept

_INFON = "array<struct<_key: string, _VALUE: string>>"
_RELATION = f"array<struct<infon: {_INFON}, node: array<struct<_refid: string, _role: string>>>>"
_ANNOTATION = f"array<struct<_id: string, infon: {_INFON}, location: array<struct<_offset: string, _length: string>>, text: string>>"
DOCUMENT = f"id string, passage array<struct<infon: {_INFON}, offset: string, text: string, annotation: {_ANNOTATION}, relation: {_RELATION}>>, relation {_RELATION}"
# Roles by which a relation names its first and its second end.
SUBJECT_ROLES, OBJECT_ROLES = ("subject", "subj", "arg1", "source", "role1"), ("object", "obj", "arg2", "target", "role2")
_BEGIN, _END = "<document>", "</document>"
_CLOSING = "\0" * 1024  # two empty blocks close an archive


def archived_documents(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """``archive`` and ``xml`` of each document in archives of XML members (.tar.gz, or .tar, or .xml.gz), of any size.

    Spark's text reader unpacks an archive as a stream and cuts it before each document, so neither an archive nor a
    member is ever held whole, and archives may lie in any store that Spark reads. What stands behind a document (headers
    of members, fillings) goes. A compressed archive is one task. A damaged archive fails the job; if ``tolerant``, the
    documents before the damage are kept, and ``archive_report`` tells which archives lack their end.
    """
    whole = _pieces(spark, path, tolerant).filter(F.contains("value", F.lit(_END)))
    return whole.select("archive", F.concat(F.lit(_BEGIN), F.substring_index("value", _END, 1), F.lit(_END)).alias("xml"))


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """archive, documents, complete: whether each archive is sound to its closing blocks. Damage doesn't fail the job."""
    pieces = _pieces(spark, path, True)
    closed = F.contains("value", F.lit(_CLOSING)) | F.col("value").rlike(r"</collection>\s*\z")
    told = pieces.groupBy("archive").agg(F.count_if(F.contains("value", F.lit(_END))).alias("documents"), F.bool_or(closed).alias("complete"))
    # An archive of which nothing can be read has no pieces; of all, only the names are read here.
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))
    return files.join(told, "archive", "left").select("archive", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("complete", F.lit(False)).alias("complete"))


def _pieces(spark: SparkSession, path: str, tolerant: bool) -> DataFrame:
    """archive, value: what follows each begin of a document up to the next, and what stands before the first."""
    return spark.read.option("lineSep", _BEGIN).option("ignoreCorruptFiles", tolerant).text(path).select(F.col("_metadata.file_path").alias("archive"), "value")


def parsed(documents: DataFrame) -> DataFrame:
    """Rows of ``DOCUMENT`` from ``xml``; documents without a number or that can't be read go."""
    # Exploded, so that a document is read once: else it is read anew for each column and filter.
    rows = documents.select(F.explode(F.array(F.from_xml("xml", DOCUMENT, {"mode": "PERMISSIVE"}))).alias("d")).select("d.*")
    return rows.filter(F.trim("id").rlike(r"^\d+$")).withColumn("pmid", F.trim("id").cast("long"))


def _infon(infons: Column, *keys: str) -> Column:
    """The first value of the keys that is neither empty nor a dash."""
    def value(key: str) -> Column:
        return F.get(F.filter(infons, lambda x: x["_key"] == key), F.lit(0))["_VALUE"]

    values = [value(k) for k in keys]
    return F.coalesce(*(F.when(~F.trim(v).isin("", "-"), F.trim(v)) for v in values))


def annotations(rows: DataFrame) -> DataFrame:
    """One row for each annotation: reference, type, mention, concept and its places."""
    found = rows.select("pmid", F.posexplode("passage").alias("passage_no", "p")).select("pmid", "passage_no", F.posexplode("p.annotation").alias("no", "a"))
    infons = F.col("a.infon")
    shaped = found.select(
        "pmid", "passage_no", "no", F.coalesce(_infon(infons, "id", "annotation_id", "annotationId"), F.nullif(F.trim("a._id"), F.lit(""))).alias("ref"),
        code_of(_infon(infons, "type"), ENTITY_TYPES).alias("entity_type"), F.trim("a.text").alias("mention_text"), _infon(infons, "identifier", "Identifier").alias("concept_id_raw"), F.col("a.location").alias("places"),
    )
    return shaped.filter("entity_type is not null and mention_text <> '' and concept_id_raw is not null")


def entities(rows: DataFrame, release: int) -> DataFrame:
    """Entity rows with offsets, each once for a document, place and concept."""
    placed = annotations(rows).select("*", F.explode("places").alias("at"))
    start, size = F.coalesce("at._offset", F.lit("0")).try_cast("int"), F.coalesce("at._length", F.lit("0")).try_cast("int")
    spans = placed.withColumns({"start_offset": start, "end_offset": start + size}).filter("start_offset >= 0 and end_offset >= start_offset")
    once = spans.groupBy("pmid", "start_offset", "end_offset", "concept_id_raw").agg(F.min_by(F.struct("entity_type", "mention_text"), F.struct("passage_no", "no")).alias("e"))
    return once.select(F.lit(release).alias("source_release_id"), "pmid", "start_offset", "end_offset", "e.entity_type", "e.mention_text", "concept_id_raw", F.lit(FROM_XML).alias("resource"))


def relations(rows: DataFrame, release: int) -> DataFrame:
    """Relation rows with both ends in the order of the tab-separated release.

    Ends are named by nodes that refer to annotations, with roles or in document order, or else
    by the ``role1`` and ``role2`` values of the relation itself.
    """
    # Read twice below, parsed once.
    rows = kept(rows.select("pmid", "passage", "relation"), "annotated")
    all_ = F.concat(F.coalesce("relation", F.array().cast(_RELATION)), F.coalesce(F.flatten(F.transform("passage", lambda p: F.coalesce(p["relation"], F.array().cast(_RELATION)))), F.array().cast(_RELATION)))
    found = rows.select("pmid", F.posexplode(all_).alias("no", "r"))
    infons = F.col("r.infon")
    named = found.select(
        "pmid", "no", code_of(relation_name(_infon(infons, "type", "relation type", "relation_type", "type-name")), RELATION_TYPES).alias("relation_type"),
        _infon(infons, "role1", "arg1", "subject", "subject_id").alias("stated_subject"), _infon(infons, "role2", "arg2", "object", "object_id").alias("stated_object"), F.col("r.node").alias("nodes"),
    ).filter("relation_type is not null")
    first = annotations(rows).filter("ref is not null").groupBy("pmid", "ref").agg(F.min_by(F.struct("concept_id_raw", "entity_type"), F.struct("passage_no", "no")).alias("e"))
    nodes = named.select("pmid", "no", F.posexplode("nodes").alias("at", "n")).select("pmid", "no", "at", F.trim("n._refid").alias("ref"), F.regexp_replace(F.lower(F.trim("n._role")), "[-_ ]", "").alias("role"))
    end = F.struct("at", "role", F.col("e.concept_id_raw").alias("id"), F.col("e.entity_type").alias("type"))
    ends = nodes.join(first, ["pmid", "ref"]).groupBy("pmid", "no").agg(F.array_sort(F.collect_list(end)).alias("ends"))
    rows_ = named.join(ends, ["pmid", "no"], "left")
    with_role = lambda roles: F.get(F.filter("ends", lambda x: x["role"].isin(*roles)), F.lit(0))
    subject = F.coalesce(with_role(SUBJECT_ROLES), F.get("ends", F.lit(0)))
    staged = rows_.withColumn("s", subject)
    other = F.get(F.filter("ends", lambda x: x["at"] != F.col("s.at")), F.lit(0))
    by_role = F.get(F.filter("ends", lambda x: x["role"].isin(*OBJECT_ROLES) & (x["at"] != F.col("s.at"))), F.lit(0))
    staged = staged.withColumn("o", F.coalesce(by_role, other))
    linked = F.size("ends") >= 2
    either = lambda a, b: F.when(linked, a).otherwise(b)
    out = staged.select(
        "pmid", "no", "relation_type", either(F.col("s.id"), F.col("stated_subject")).alias("subject_entity_id"), either(F.col("o.id"), F.col("stated_object")).alias("object_entity_id"),
        either(F.col("s.type"), entity_type_of(F.col("stated_subject"))).alias("subject_type"), either(F.col("o.type"), entity_type_of(F.col("stated_object"))).alias("object_type"),
    ).filter("subject_entity_id is not null and object_entity_id is not null")
    keys = ["pmid", "relation_type", "subject_entity_id", "object_entity_id"]
    once = out.groupBy(*keys).agg(F.min_by(F.struct("subject_type", "object_type"), "no").alias("t"))
    return once.select(F.lit(release).alias("source_release_id"), *keys, "t.subject_type", "t.object_type", F.lit(FROM_XML).alias("relation_source"))
