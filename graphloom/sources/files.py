"""Tables and raw release files in and out, by Spark's own readers on any file system."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.codes import ENTITY_TYPES, FROM_TSV, RELATION_TYPES, code_of, entity_type_of, relation_name
from graphloom.functions.text import blank_to_null, canonical_digest, clean_inventory_name, doi, iso_date, whole_number

#: The tables of a bundle and those it can't be without.
REQUIRED, OPTIONAL = ("base_points", "base_clusters"), ("universe_points", "universe_links", "cluster_exemplars", "paper_documents")
LATEST_VERSION = 4
#: Tables of old bundles that a new one must not have.
DEPRECATED = (
    "corpus_points", "corpus_clusters", "reservoir_points", "corpus_documents", "corpus_cluster_exemplars", "corpus_links",
    "graph_points", "graph_clusters", "graph_facets", "graph_cluster_exemplars", "paper_points",
)

PAPERS = """corpusid long, title string, venue string, year int, publicationdate string, isopenaccess boolean, publicationvenueid string,
 externalids struct<PubMed: string, DOI: string, PubMedCentral: string>, authors array<struct<authorId: string, name: string>>, openaccessinfo struct<url: string, status: string>"""
VENUES, AUTHORS = "id string, issn string, name string", "authorid string, name string, externalids struct<ORCID: string>"
ABSTRACTS, TLDRS = "corpusid long, abstract string", "corpusid long, text string"
CITATIONS = "citationid long, citingcorpusid long, citedcorpusid long, isinfluential boolean, intents array<string>"
S2ORC = "corpusid long, body struct<text: string, annotations: struct<section_header: string, paragraph: string, sentence: string>>"
FAMILIES = {"publication-venues": VENUES, "authors": AUTHORS, "papers": PAPERS, "abstracts": ABSTRACTS, "tldrs": TLDRS, "citations": CITATIONS, "s2orc_v2": S2ORC}
#: Families that a release is read for unless others are named, and those without which it can't be read.
BY_DEFAULT = ("publication-venues", "authors", "papers", "abstracts", "citations")
NEEDED = ("publication-venues", "authors", "papers", "abstracts", "citations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass
class Bundle:
    """The tables of a published folder, each read when it is first asked for."""

    spark: SparkSession
    folder: str
    manifest: dict
    read: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str, columns: Iterable[str] | None = None) -> DataFrame:
        if name not in self.manifest["tables"]:
            raise KeyError(name)
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.folder}/{self.manifest['tables'][name]['file']}")
        return self.read[name].select(*columns) if columns else self.read[name]


def normalised_manifest(row: dict) -> dict:
    """A bundle's manifest from the row of the run that made it: the manifest's own values before the row's.

    Tables that name no file are left out; the version is a whole number, 0 if it is none.
    """
    own = row.get("bundle_manifest")
    own = own if isinstance(own, dict) else {}
    text = lambda name, other: own[name] if isinstance(own.get(name), str) else row.get(other)
    tables = own.get("tables") if isinstance(own.get("tables"), dict) else {}
    version = str(own.get("bundle_version", own.get("version", row.get("bundle_version")))).strip()
    return {
        "format": text("bundle_format", "bundle_format"), "graph_name": text("graph_name", "graph_name"), "run_id": text("graph_run_id", "id"), "created_at": text("created_at", "created_at"),
        "version": int(version) if version.isdecimal() else 0, "tables": {name: t for name, t in tables.items() if isinstance(t, dict) and isinstance(t.get("file"), str)},
    }


def manifest_problems(manifest: dict) -> list[str]:
    """What is wrong with a manifest: tables that lack, are old or unknown, and the version."""
    tables = manifest.get("tables", {})
    problems = [f"no table {t}" for t in REQUIRED if t not in tables]
    problems += [f"{'old' if t in DEPRECATED else 'unknown'} table {t}" for t in tables if t not in REQUIRED + OPTIONAL]
    if not 1 <= int(manifest.get("version", 0)) <= LATEST_VERSION:
        problems.append(f"version {manifest.get('version')}")
    return problems


def open_bundle(spark: SparkSession, folder: str, verify: bool = True) -> Bundle:
    """A bundle by its ``manifest.json``: version, tables, and (``verify``) file digests."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])
    problems = manifest_problems(manifest)
    if verify and not problems:
        problems += mismatched(spark, folder, {x["file"]: x["sha256"] for x in manifest["tables"].values()})
    if problems:
        raise ValueError(f"bundle {folder}: {'; '.join(problems)}")
    return Bundle(spark, folder, manifest)


def mismatched(spark: SparkSession, folder: str, digests: dict[str, str]) -> list[str]:
    """Files (by their path below the folder) whose SHA-256 differs from what is stated; each is digested in one task."""
    folder = folder.rstrip("/")
    paths = [f"{folder}/{name}" for name in digests]
    found = spark.read.format("binaryFile").load(paths).select(F.substring_index("path", folder.rsplit("/", 1)[-1] + "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    have = {r["file"]: r["sha256"] for r in found.collect()}  # one row for each file of the manifest
    return [f"digest of {name}" for name, digest in digests.items() if have.get(name) != digest]


def file_plan(manifest: dict, families: Iterable[str] = BY_DEFAULT, max_files: int | None = None) -> list[tuple[str, str, str]]:
    """(family, path, kind) of the files to read; kinds by suffix."""
    kinds = {".jsonl.gz": "json", ".jsonl": "json", ".tsv.gz": "tsv", ".tar.gz": "tar", ".gz": "tsv", ".xml": "xml"}
    out = []
    for family in families:
        for path in sorted(manifest.get(family, []))[:max_files]:
            out.append((family, path, next((k for s, k in kinds.items() if path.endswith(s)), "other")))
    return out


def manifest_checksum(manifest: dict) -> str:
    """SHA-256 of a manifest as canonical JSON: sorted names, no white space."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def needed_missing(manifest: dict) -> list[str]:
    return [family for family in NEEDED if not manifest.get(family)]


def json_lines(spark: SparkSession, path: str | list[str], family: str, per_file: int | None = None) -> DataFrame:
    """Rows of one family's JSON lines; a line that is no object of the family stops the read.

    ``per_file`` keeps the first rows of each file, by position.
    """
    reader = spark.read.schema(FAMILIES[family]).option("mode", "FAILFAST")
    if per_file is None:
        return reader.json(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).filter(F.col("n") <= per_file)
    return first.select(F.from_json("value", FAMILIES[family], {"mode": "FAILFAST"}).alias("row")).select("row.*")


def venues(raw: DataFrame) -> DataFrame:
    return raw.select(blank_to_null(F.col("id")).alias("source_venue_id"), blank_to_null(F.col("issn")).alias("issn"), F.coalesce(blank_to_null(F.col("name")), F.lit("Unknown venue")).alias("name"))


def authors(raw: DataFrame) -> DataFrame:
    return raw.select(blank_to_null(F.col("authorid")).alias("source_author_id"), F.coalesce(blank_to_null(F.col("name")), F.lit("Unknown author")).alias("name"), blank_to_null(F.col("externalids.ORCID")).alias("orcid"))


def papers(raw: DataFrame, release: int) -> DataFrame:
    ids = {c: blank_to_null(F.col(f"externalids.{c}")) for c in ("PubMed", "DOI", "PubMedCentral")}
    shaped = raw.select(
        F.col("corpusid").cast("string").alias("paper_id"), F.lit(release).alias("source_release_id"), blank_to_null(F.col("publicationvenueid")).alias("source_venue_id"), doi(ids["DOI"]).alias("doi_norm"),
        whole_number(ids["PubMed"]).alias("pmid"), ids["PubMedCentral"].alias("pmc_id"), blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("venue")).alias("venue_raw"),
        "year", iso_date(F.col("publicationdate")).alias("publication_date"), F.col("isopenaccess").alias("is_open_access"),
    )
    return shaped.withColumn("payload_checksum", canonical_digest(*shaped.columns))


def paper_authors(raw: DataFrame) -> DataFrame:
    """One row for each author of a paper, numbered from 0."""
    rows = raw.select(F.col("corpusid").cast("string").alias("paper_id"), F.posexplode("authors").alias("author_ordinal", "a"))
    return rows.select("paper_id", "author_ordinal", blank_to_null(F.col("a.authorId")).alias("source_author_id"), F.coalesce(blank_to_null(F.col("a.name")), F.lit("Unknown author")).alias("name_raw"))


def paper_assets(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.col("corpusid").cast("string").alias("paper_id"), blank_to_null(F.col("openaccessinfo.url")).alias("url"), blank_to_null(F.col("openaccessinfo.status")).alias("status"))
    return rows.filter("url is not null")


def patches(raw: DataFrame, column: str) -> DataFrame:
    """paper_id and one text column (``abstract`` or ``text``)."""
    return raw.select(F.col("corpusid").cast("string").alias("paper_id"), blank_to_null(F.col(column)).alias(column))


def citations(raw: DataFrame) -> DataFrame:
    intents = F.filter(F.transform("intents", lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        "citationid", F.col("citingcorpusid").cast("string").alias("citing_paper_id"), F.col("citedcorpusid").cast("string").alias("cited_paper_id"),
        F.coalesce("isinfluential", F.lit(False)).alias("is_influential"), F.array_join(intents, ",").alias("intents"),
    )


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ordinal (from 0) and value of every line; lines of one file are numbered by its blocks."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return lines.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1).alias("ordinal"), "value")


def citation_checksums(lines: DataFrame) -> DataFrame:
    """``citations`` of ``numbered_lines`` with a SHA-256 over the file's name, the line's number and what it says."""
    rows = lines.select("file", "ordinal", F.from_json("value", CITATIONS, {"mode": "FAILFAST"}).alias("c")).select("file", "ordinal", "c.*")
    intents = F.array_join(F.filter(F.transform("intents", lambda x: F.trim(x)), lambda x: x != ""), ",")
    influential = F.coalesce("isinfluential", F.lit(False))
    said = F.struct("citationid", "citedcorpusid", "citingcorpusid", F.col("file").alias("file_name"), F.nullif(intents, F.lit("")).alias("intents"), influential.alias("isinfluential"), "ordinal")
    return rows.select(
        F.col("citingcorpusid").cast("string").alias("citing_paper_id"), F.col("citedcorpusid").cast("string").alias("cited_paper_id"), "ordinal",
        F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256).alias("reference_checksum"), influential.alias("is_influential"),
    )


def _tabbed(lines: DataFrame, size: int) -> DataFrame:
    """Fields ``f`` of lines with at least ``size`` fields and a number in front; there is no quoting."""
    cut = lines.select(F.split("value", "\t").alias("f"))
    return cut.filter((F.size("f") >= size) & F.trim(F.get("f", F.lit(0))).rlike(r"^\d+$"))


def bioconcepts(lines: DataFrame, release: int) -> DataFrame:
    """Entity rows of tab-separated lines. They state no place, so all offsets are 0."""
    field_ = lambda i: F.trim(F.get("f", F.lit(i)))
    rows = _tabbed(lines, 5).select(
        F.lit(release).alias("source_release_id"), field_(0).cast("long").alias("pmid"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"),
        code_of(field_(1), ENTITY_TYPES).alias("entity_type"), field_(3).alias("mention_text"), field_(2).alias("concept_id_raw"), F.lit(FROM_TSV).alias("resource"),
    )
    return rows.filter("entity_type is not null and mention_text <> '' and concept_id_raw <> '' and concept_id_raw <> '-'")


def relations(lines: DataFrame, release: int) -> DataFrame:
    """Relation rows of tab-separated lines; types of both ends by their identifiers."""
    field_ = lambda i: F.trim(F.get("f", F.lit(i)))
    rows = _tabbed(lines, 4).select(
        F.lit(release).alias("source_release_id"), field_(0).cast("long").alias("pmid"), code_of(relation_name(field_(1)), RELATION_TYPES).alias("relation_type"),
        field_(2).alias("subject_entity_id"), field_(3).alias("object_entity_id"), entity_type_of(field_(2)).alias("subject_type"), entity_type_of(field_(3)).alias("object_type"), F.lit(FROM_TSV).alias("relation_source"),
    )
    return rows.filter("relation_type is not null and subject_entity_id <> '' and object_entity_id <> ''")


def vocabulary(spark: SparkSession, path: str, arrays: Iterable[str] = ("semantic_types", "semantic_groups", "organ_systems"), name: str = "canonical_name") -> DataFrame:
    """A curated tab-separated file with a header; rows without a name go, missing lists are empty."""
    rows = spark.read.csv(path, sep="\t", header=True).filter(F.trim(name) != "")
    listed = lambda c: F.coalesce(F.filter(F.split(F.regexp_replace(c, r"^\{|\}$", ""), ","), lambda x: x != ""), F.array().cast("array<string>"))
    return rows.withColumns({c: listed(c) for c in arrays if c in rows.columns})


def journal_names(inventory: DataFrame) -> DataFrame:
    """Distinct clean names of longer than two characters among titles and abbreviations."""
    names = inventory.select(F.explode(F.array("title", "medline_abbr")).alias("raw"))
    return names.select(clean_inventory_name(F.col("raw")).alias("normalized_venue")).filter(F.length("normalized_venue") > 2).distinct()


def quoted_csv(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``line`` of each row, every value in quotation marks, nulls empty, in order."""
    value = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return rows.orderBy(order).select(F.concat_ws(",", *map(value, columns)).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this name that all executors share: under ``spark.checkpoint.dir``, local only in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to ``scratch`` and read back, for what several later steps read."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append(batch: DataFrame, path: str, by: Iterable[str] = ()) -> None:
    writer = batch.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def overwrite_slices(batch: DataFrame, path: str, by: Iterable[str]) -> None:
    """Only the partitions that the batch has are replaced."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(rows: DataFrame, folder: str, name: str, level: int = 3, group_bytes: int = 128 << 20) -> str:
    """Writes a new version beside the old ones and returns its path; readers switch by pointer."""
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", group_bytes).parquet(path)
    return path


def attach(universe: DataFrame, stage: DataFrame, most: int = 1000, key: str = "id") -> DataFrame:
    """Fetched rows in place of stored rows of the same id; at most ``most`` at once."""
    if stage.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return universe.join(F.broadcast(stage.select(key)), key, "left_anti").unionByName(stage)


