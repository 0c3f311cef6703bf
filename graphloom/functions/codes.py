"""Codes and rules that rows of other systems refer to."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type codes, curated venue patterns, entity rules and relation rules.
ENTITY_TYPES = {"Gene": 1, "Disease": 2, "Chemical": 3, "Species": 4, "Mutation": 5, "CellLine": 6}
RELATION_TYPES = {
    "associate": 1, "treat": 2, "negative_correlate": 3, "cause": 4, "positive_correlate": 5, "stimulate": 6,
    "inhibit": 7, "cotreat": 8, "compare": 9, "interact": 10, "prevent": 11, "drug_interact": 12,
}
FROM_XML, FROM_TSV = 1, 2
VENUE_PATTERNS = [
    ("frontiers_in_neuro", "frontiers in neuro%", True),
    ("frontiers_in_psychiatry", "frontiers in psychiatr%", True),
    ("frontiers_in_pharmacology", "frontiers in pharmacol%", True),
    ("frontiers_in_aging_neuroscience", "frontiers in aging neuroscience", True),
    ("frontiers_in_behavioral_neuroscience", "frontiers in behavioral neuroscience", True),
    ("brain_research_family", "brain research%", True),
    ("brain_sciences", "brain sciences", True),
    ("neuropharmacology_family", "%neuropharmacol%", True),
    ("psychopharmacology_family", "%psychopharmacol%", True),
    ("neuropsychiatry_family", "%neuropsychiatr%", True),
    ("neuroimmunology_family", "%neuroimmunol%", True),
    ("neuroendocrinology_family", "%neuroendocrinol%", True),
    ("neuropathology_family", "%neuropathol%", True),
    ("neurotoxicology_family", "%neurotoxicol%", True),
]
ENTITY_RULES = [
    (2, "MESH:D010554", "Aggression", "behavior", "high", 0),
    (2, "MESH:D007174", "Impulsivity", "behavior", "high", 0),
    (2, "MESH:D003072", "Cognitive impairment", "behavior", "high", 0),
    (2, "MESH:D003693", "Delirium", "behavior", "high", 0),
    (2, "MESH:D011595", "Agitation", "behavior", "high", 0),
    (2, "MESH:D002389", "Catatonia", "behavior", "high", 0),
    (2, "MESH:D006212", "Hallucinations", "behavior", "high", 0),
    (2, "MESH:D063726", "Delusions", "behavior", "high", 0),
    (2, "MESH:D001927", "Encephalopathy", "systemic_bridge", "high", 0),
    (2, "MESH:D020230", "Serotonin syndrome", "iatrogenic_syndrome", "high", 0),
    (2, "MESH:D009459", "Neuroleptic malignant syndrome", "iatrogenic_syndrome", "high", 0),
    (1, "627", "BDNF", "neurotransmitter_gene", "requires_second_gate", 0),
    (1, "6531", "DAT", "neurotransmitter_gene", "requires_second_gate", 0),
    (1, "6532", "SERT", "neurotransmitter_gene", "requires_second_gate", 0),
    (1, "1312", "COMT", "neurotransmitter_gene", "requires_second_gate", 0),
    (1, "4128", "MAOA", "neurotransmitter_gene", "requires_second_gate", 0),
]
RELATION_RULES = [
    (3, 4, 2, "MESH:D015430", "Weight gain", "metabolic_toxicity", 0),
    (3, 4, 2, "MESH:D024821", "Metabolic syndrome", "metabolic_toxicity", 0),
    (3, 4, 2, "MESH:D006943", "Hyperglycemia", "metabolic_toxicity", 0),
    (3, 4, 2, "MESH:D009205", "Myocarditis", "cardiac_toxicity", 0),
    (3, 4, 2, "MESH:D000380", "Agranulocytosis", "hematologic_toxicity", 0),
    (3, 4, 2, "MESH:D009503", "Neutropenia", "hematologic_toxicity", 0),
    (3, 4, 2, "MESH:D045823", "Ileus", "gi_toxicity", 0),
]
DIRECT_CONFIDENCES, SECOND_GATE = ("high", "moderate"), ("requires_second_gate",)

PATTERN_SCHEMA = "pattern_key string, like_pattern string, promotes_to_mapped boolean"
ENTITY_RULE_SCHEMA = "entity_type int, concept_id_raw string, canonical_name string, family_key string, confidence string, min_reference_count int"
RELATION_RULE_SCHEMA = "subject_type int, relation_type int, object_type int, object_id_raw string, canonical_name string, family_key string, min_reference_count int"


def code_of(name: Column, codes: dict[str, int]) -> Column:
    """The code of a name; null if it has none."""
    return F.try_element_at(F.create_map(*map(F.lit, itertools.chain(*codes.items()))), name)


def relation_name(raw: Column) -> Column:
    """A relation type in the form of ``RELATION_TYPES``."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), "[- ]", "_")
    return F.when(bare == "association", "associate").otherwise(bare)


def entity_type_of(identifier: Column) -> Column:
    """The type that an identifier shows: ``type|id``, else its prefix, else a chemical."""
    stated = F.regexp_replace(F.lower(F.trim(F.split_part(identifier, F.lit("|"), F.lit(1)))), "[-_ ]", "")
    by_name = code_of(stated, {name.lower(): code for name, code in ENTITY_TYPES.items()})
    bar = F.instr(identifier, "|")
    rest = F.when(bar > 0, F.substring(identifier, bar + 1, F.length(identifier))).otherwise(identifier)
    by_prefix = F.when(rest.startswith("MESH:"), 2).when(rest.startswith("NCBIGene:"), 1).otherwise(3)
    return F.when((bar > 0) & by_name.isNotNull(), by_name).otherwise(by_prefix)


def palette_colour(cluster: Column, palette: list[str], noise: str) -> Column:
    """A cluster's colour; clusters up to 0 are noise."""
    at = F.element_at(F.array(*map(F.lit, palette)), (cluster % len(palette) + 1).cast("int"))
    return F.when(F.coalesce(cluster, F.lit(0)) <= 0, noise).otherwise(at)
