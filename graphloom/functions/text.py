"""Normalising text expressions. All are native columns, null in and null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """The trimmed text; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def lookup_key(text: Column) -> Column:
    """Lower case, outer spaces off, inner white space as one space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " "), F.lit(""))


def clean_venue(name: Column) -> Column:
    """A journal's bare name: no article in front, subtitle, bracketed tail or (one) last full stop."""
    bare = F.trim(F.lower(name))
    for tail in (r"\.\z", r"\Athe\s+", r"(?s)\s*:\s*.*\z", r"(?s)\s*\([^)]*\)\s*\z"):
        bare = F.regexp_replace(bare, tail, "")
    return F.nullif(F.trim(bare), F.lit(""))


def clean_inventory_name(name: Column) -> Column:
    """As ``clean_venue``, for curated names: all last full stops and every kind of outer space go."""
    bare = F.regexp_replace(F.lower(name), r"\A\s+|\s+\z", "")
    for tail in (r"\.+\z", r"\Athe\s+", r"(?s)\s*:\s*.*\z", r"(?s)\s*\([^)]*\)\s*\z", r"\A\s+|\s+\z"):
        bare = F.regexp_replace(bare, tail, "")
    return F.nullif(bare, F.lit(""))


def whole_number(text: Column) -> Column:
    """The text as long; null if it is not a number."""
    return F.trim(text).try_cast("long")


def iso_date(text: Column) -> Column:
    """The first ten characters as a date; null if they are none."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def doi(text: Column) -> Column:
    return F.lower(blank_to_null(text))


def with_pmc_prefix(identifier: Column) -> Column:
    """``PMC`` in front unless it is there in any case."""
    return F.when(identifier.rlike("(?i)^PMC"), identifier).otherwise(F.concat(F.lit("PMC"), identifier))


def pmc_identifier(identifier: Column) -> Column:
    """Upper-case ``PMC`` and digits; null for anything else."""
    full = with_pmc_prefix(F.upper(F.trim(identifier)))
    return F.when(full.rlike(r"^PMC\d+$"), full)


def list_values(text: Column) -> Column:
    """The parts of a comma-separated value, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\s*,\s*"), lambda x: F.trim(x)), lambda x: x != "")


def short_digest(text: Column) -> Column:
    """The first 16 bytes of the SHA-1 digest of a text, in hexadecimal."""
    return F.substring(F.sha1(text), 1, 32)


def joined_digest(separator: str, *columns: Column) -> Column:
    """SHA-256 of columns joined by a separator; nulls are left out of the join."""
    return F.sha2(F.concat_ws(separator, *columns), 256)


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of a JSON object of the columns in order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def wiki_links(markdown: Column) -> Column:
    """Targets of ``[[...]]`` links other than citations, as slugs."""
    found = F.regexp_extract_all(markdown, F.lit(r"\[\[(?!pmid:)([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.transform(found, slug)


def cited_pmids(markdown: Column) -> Column:
    """Numbers of ``[[pmid:...]]`` citations."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"\[\[pmid:(\d+)\]\]"), F.lit(1)), lambda x: x.cast("long"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-")


def sentence_texts(text: Column) -> Column:
    """Stretches up to a full stop, question or exclamation mark, trimmed; blank ones are left out."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]?"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


def section_role(label: Column) -> Column:
    """The role that a heading of an annotated document names; ``other`` if none."""
    bare = F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))
    return (
        F.when(bare.contains("abstract"), "abstract")
        .when(bare.contains("introduction") | (bare == "intro"), "introduction")
        .when(bare.contains("method") | bare.contains("materials"), "methods")
        .when(bare.contains("result"), "results")
        .when(bare.contains("discuss"), "discussion")
        .when(bare.contains("conclusion"), "conclusion")
        .when(bare.contains("supplement"), "supplement")
        .otherwise("other")
    )


def passage_role(section: Column, label: Column) -> Column:
    """The role that a passage's section type and label name; wider keywords than ``section_role``."""
    both = F.lower(F.concat_ws(" ", section, label))
    return (
        F.when(both.contains("abstract"), "abstract")
        .when(both.contains("intro"), "introduction")
        .when(both.contains("method") | both.contains("materials"), "methods")
        .when(both.contains("result"), "results")
        .when(both.contains("discuss"), "discussion")
        .when(both.contains("conclu") | both.contains("summary"), "conclusion")
        .when(both.contains("supp") | both.contains("append"), "supplement")
        .otherwise("other")
    )


def appended(values: Column, value: Column) -> Column:
    """The array with the value at its end unless it holds it."""
    own = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, value), own).otherwise(F.array_append(own, value))


def paper_references(values: Column) -> Column:
    """Trimmed references without blank and repeated ones, in their first order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def name_uuid(namespace: str, name: Column) -> Column:
    """The UUID of version 5 of a name in a namespace (a UUID as text)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    at = lambda first, size: F.substring(digest, first, size)
    variant = F.lower(F.hex(F.conv(at(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(F.substring(variant, -1, 1), at(18, 3)), at(21, 12))


def evidence_key(namespace: str, version: Column, *ordinals: Column) -> Column:
    """The key of an evidence unit: its document, kind, section, block and sentences, and the version of the chunking."""
    return name_uuid(namespace, F.concat_ws("|", *(o.cast("string") for o in ordinals), version))
