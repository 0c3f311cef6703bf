"""Full texts as sections, blocks and sentences, and audits of what was parsed.

Annotated documents are taken apart within their own row by array functions: nothing is shuffled
and no document meets another. BioC passages carry a state from one to the next, so a small
helper walks them, document by document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import passage_role, section_role, short_digest

_SPAN = "array<struct<start:int,end:int,n:string>>"
#: The first paragraphs that are searched by default even outside known sections.
LEADING = 5
CHUNK_TARGET, CHUNK_MOST = 256, 384


def sentence_spans(text: Column, start: Column) -> Column:
    """start, end of each sentence of a paragraph, in the document's offsets.

    A sentence runs to a full stop, question or exclamation mark; further marks belong to none.
    """
    pieces = F.filter(F.split(text, r"(?<=[.!?])(?=[^.!?])"), lambda p: F.length(p) > 0)
    sizes = F.transform(pieces, lambda p: F.length(p))
    # Where each piece begins, added up once.
    begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))

    def span(pair: Column) -> Column:
        piece = pair["piece"]
        lead = F.length(F.regexp_extract(piece, r"^[.!?]*", 0))
        body = F.regexp_extract(piece, r"(?s)[^.!?]+[.!?]?", 0)
        at = start + pair["begin"] + lead
        return F.struct(at.alias("start"), (at + F.length(body)).alias("end"), (F.trim(body) == "").alias("blank"))

    pairs = F.arrays_zip(pieces.alias("piece"), F.slice(begins, F.lit(1), F.size(pieces)).alias("begin"))
    found = F.filter(F.transform(pairs, span), lambda s: ~s["blank"])
    whole = F.array(F.struct(start.alias("start"), (start + F.length(text)).alias("end"), F.lit(False).alias("blank")))
    spans = F.when((F.size(found) == 0) & (F.trim(text) != ""), whole).otherwise(found)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _cut(text: str, span: Column) -> Column:
    return F.trim(F.substring(F.col(text), span["start"] + 1, span["end"] - span["start"]))


def annotated(raw: DataFrame) -> DataFrame:
    """paper_id, body and sorted spans of headings, paragraphs and sentences (JSON texts or arrays)."""
    item = "array<struct<start:int,end:int,attributes:struct<n:string>>>"
    spans = lambda c: F.coalesce(F.transform(F.array_sort(F.from_json(F.col(f"body.annotations.{c}").cast("string"), item)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.nullif(F.trim(x["attributes"]["n"]), F.lit("")).alias("n"))), F.array().cast(_SPAN))
    return raw.select(F.col("corpusid").cast("string").alias("paper_id"), F.coalesce("body.text", F.lit("")).alias("body"), spans("section_header").alias("headers"), spans("paragraph").alias("paragraphs"), spans("sentence").alias("spans"))


def structured(documents: DataFrame) -> DataFrame:
    """``annotated`` rows with arrays ``sections``, ``blocks`` and ``sentences`` and a text digest."""
    label = lambda h: F.trim(F.regexp_replace(_cut("body", h), r"\s+", " "))
    preamble = F.struct(F.lit("Preamble").alias("display_label"), F.lit("other").alias("section_role"), F.lit(None).cast("string").alias("n"), F.get("paragraphs", F.lit(0))["start"].alias("start"))
    heads = F.filter(F.transform("headers", lambda h: F.struct(F.substring(label(h), 1, 255).alias("display_label"), section_role(label(h)).alias("section_role"), h["n"].alias("n"), h["start"].alias("start"))), lambda s: s["display_label"] != "")
    early = (F.size("paragraphs") > 0) & ((F.size("headers") == 0) | (F.get("paragraphs", F.lit(0))["start"] < F.get("headers", F.lit(0))["start"]))
    rows = documents.withColumn("heads", F.when(early, F.concat(F.array(preamble), heads)).otherwise(heads))

    def section(s: Column, i: Column) -> Column:
        token = F.regexp_extract(s["n"], r"^(.*)\.[^.]*$", 1)
        earlier = F.filter(F.transform(F.slice("heads", 1, i), lambda x, j: F.struct(j.alias("j"), x["n"].alias("n"))), lambda x: x["n"] == token)
        parent = F.when(s["n"].contains("."), F.array_max(F.transform(earlier, lambda x: x["j"])))
        return F.struct(i.alias("section_ordinal"), parent.alias("parent_section_ordinal"), s["section_role"].alias("section_role"), s["n"].alias("numbering_token"), s["display_label"].alias("display_label"), s["start"].alias("source_start_offset"))

    rows = rows.withColumn("sections", F.transform("heads", section))
    # The last section that starts no later; before all of them, the first.
    at = lambda start: F.coalesce(F.get(F.reverse(F.filter("sections", lambda s: s["source_start_offset"] <= start)), F.lit(0)), F.get("sections", F.lit(0)))
    texts = F.filter(F.transform("paragraphs", lambda p, i: F.struct(i.alias("i"), p["start"].alias("start"), p["end"].alias("end"), _cut("body", p).alias("text"), at(p["start"]).alias("s"))), lambda p: p["text"] != "")
    role = lambda p: F.coalesce(p["s"]["section_role"], F.lit("other"))
    block = lambda p, i: F.struct(i.alias("block_ordinal"), F.coalesce(p["s"]["section_ordinal"], F.lit(0)).alias("section_ordinal"), p["start"].alias("start_offset"), p["end"].alias("end_offset"), F.lit("paragraph").alias("block_kind"), role(p).alias("section_role"), ((role(p) != "other") | (p["i"] < LEADING)).alias("is_retrieval_default"), p["text"].alias("text"))
    rows = rows.withColumn("blocks", F.transform(texts, block))
    # A sentence belongs to the first block that encloses it.
    owner = lambda s: F.get(F.filter("blocks", lambda b: (b["start_offset"] <= s["start"]) & (s["end"] <= b["end_offset"])), F.lit(0))["block_ordinal"]
    rows = rows.withColumn("owned", F.filter(F.transform("spans", lambda s: F.struct(owner(s).alias("b"), s["start"].alias("start"), s["end"].alias("end"))), lambda s: s["b"].isNotNull()))

    def of_block(b: Column) -> Column:
        own = F.transform(F.filter("owned", lambda s: s["b"] == b["block_ordinal"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        spans = F.when(F.size(own) > 0, own).otherwise(sentence_spans(b["text"], b["start_offset"]))
        shaped = F.transform(spans, lambda s, i: F.struct(b["block_ordinal"].alias("block_ordinal"), i.alias("sentence_ordinal"), b["section_ordinal"].alias("section_ordinal"), s["start"].alias("start_offset"), s["end"].alias("end_offset"), _cut("body", s).alias("text")))
        return F.filter(shaped, lambda s: s["text"] != "")

    rows = rows.withColumn("sentences", F.flatten(F.transform("blocks", of_block)))
    digest = short_digest(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))
    return rows.select("paper_id", "sections", "blocks", "sentences", digest.alias("text_hash"))


def spine(documents: DataFrame, part: str, key: str = "paper_id") -> DataFrame:
    """One row for each of ``sections``, ``blocks`` or ``sentences``."""
    return documents.select(key, F.explode(part).alias("_x")).select(key, "_x.*")


# Last words by which a heading is a broken line, and words of parts that are not searched.
BROKEN_ENDS = ("and", "for", "from", "in", "of", "or", "the", "to", "with")
NOT_SEARCHED = ("reference", "acknowledg", "author contribution", "conflict", "competing interest", "funding", "financial support", "disclosure", "keyword", "abbreviation")
SHAPES = {"paragraph": ("paragraph", True), "abstract": ("paragraph", True), "fig_caption": ("figure_caption", True), "table_caption": ("table_caption", True), "table": ("table_body", False), "table_footnote": ("table_body", False)}
_PASSAGE = "{key} string, ordinal int, kind string, section_type string, asset string, start_offset int, text string"


def passages(documents: DataFrame, key: str = "corpus_id", xml: str = "xml") -> DataFrame:
    """The passages of BioC XML, trimmed, in order; a document that can't be read gives none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch[key], batch[xml], strict=True):
                try:
                    root = ET.fromstring(content)
                except (ET.ParseError, TypeError):
                    continue
                document = root if root.tag == "document" else root.find("document")
                for i, p in enumerate([] if document is None else document.findall("passage")):
                    infons = {x.get("key"): x.text or "" for x in p.findall("infon")}
                    raw, offset = p.findtext("text") or "", p.findtext("offset") or "0"
                    if raw.strip() and re.fullmatch(r"\s*-?\d+\s*", offset):
                        start = int(offset) + len(raw) - len(raw.lstrip())
                        out.append((name, i, infons.get("type", "").strip().lower(), infons.get("section_type", "").strip(), infons.get("id") or infons.get("file"), start, raw.strip()))
            yield pd.DataFrame(out, columns=[key, "ordinal", "kind", "section_type", "asset", "start_offset", "text"])

    rows = documents.select(F.col(key).cast("string").alias(key), F.col(xml).cast("string").alias(xml))
    return rows.mapInPandas(read, _PASSAGE.format(key=key))


def bioc_blocks(rows: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Blocks of ``passages`` with their section.

    Headings open a section unless they are broken lines or repeat the label of the one that is
    open; an abstract, or a passage whose type names another role, opens one by itself. Front
    matter gives no block.
    """
    label = F.trim(F.regexp_replace("text", r"\s+", " "))
    heading = F.col("kind").rlike("^(title_|abstract_title)|_title$")
    ends_badly = F.lower(label).rlike(r"[-(]$") | ((F.size(F.split(label, " ")) >= 2) & F.lower(F.element_at(F.split(label, " "), -1)).isin(*BROKEN_ENDS))
    usual = F.initcap(F.trim(F.replace(F.col("section_type"), F.lit("_"), F.lit(" "))))
    tagged = rows.filter(F.col("kind") != "front").select(
        key, "ordinal", "kind", "section_type", "asset", "start_offset", "text", heading.alias("heading"), label.alias("label"), F.when(usual == "", "Section").otherwise(usual).alias("usual"),
        passage_role(F.col("section_type"), label).alias("role_with_label"), passage_role(F.col("section_type"), F.lit("")).alias("role"),
    ).filter(~(F.col("heading") & ends_badly))
    columns = [c for c in tagged.columns if c != key]

    def walked(documents: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in documents:
            out = []
            for name, own in zip(batch[key], batch["own"], strict=True):
                section, open_label, open_role, block = 0, "Front matter", "other", 0
                for p in own:
                    opened = None
                    if p["heading"]:
                        opened = None if p["label"] == open_label else (p["label"], p["role_with_label"])
                    elif p["kind"] == "abstract" and open_role != "abstract":
                        opened = ("Abstract", "abstract")
                    elif p["role"] not in ("other", open_role):
                        opened = (p["usual"], p["role"])
                    if opened:
                        section, (open_label, open_role) = section + 1, opened
                    if p["heading"]:
                        continue
                    kind, searched = SHAPES.get(p["kind"], ("other", False))
                    words = f"{p['kind']} {p['section_type']} {open_label}".lower().replace("_", " ")
                    searched = searched and p["section_type"].upper() != "REF" and not any(w in words for w in NOT_SEARCHED)
                    out.append((name, block, section, open_label[:255], open_role, kind, searched, p["asset"], p["start_offset"], p["start_offset"] + len(p["text"]), p["text"]))
                    block += 1
            yield pd.DataFrame(out, columns=names)

    names = [key, "block_ordinal", "section_ordinal", "display_label", "section_role", "block_kind", "is_retrieval_default", "linked_asset_ref", "start_offset", "end_offset", "text"]
    # One document's passages are one row: a document is bounded, its number of passages small.
    grouped = tagged.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own"))
    return grouped.mapInPandas(walked, f"{key} string, block_ordinal int, section_ordinal int, display_label string, section_role string, block_kind string, is_retrieval_default boolean, linked_asset_ref string, start_offset int, end_offset int, text string")


def block_sentences(blocks: DataFrame, key: str = "corpus_id") -> DataFrame:
    """One row for each sentence of a block, with offsets."""
    spans = blocks.select(key, "block_ordinal", "section_ordinal", "start_offset", "text", F.posexplode(sentence_spans(F.col("text"), F.col("start_offset"))).alias("sentence_ordinal", "s"))
    cut = F.trim(F.substring(F.col("text"), F.col("s.start") - F.col("start_offset") + 1, F.col("s.end") - F.col("s.start")))
    return spans.select(key, "block_ordinal", "sentence_ordinal", "section_ordinal", F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset"), cut.alias("text")).filter("text <> ''")


def chunks(blocks: DataFrame, key: str = "corpus_id", target: int = CHUNK_TARGET, most: int = CHUNK_MOST) -> DataFrame:
    """Neighbouring blocks of one section joined to chunks of about ``target`` words.

    A chunk closes once it has ``target`` words or the next block would lead over ``most``.
    """
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = blocks.select(key, "section_ordinal", F.struct("block_ordinal", words.alias("words"), "text").alias("b")).groupBy(key, "section_ordinal").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    state = "struct<done:array<struct<first:int,words:int,text:string>>,open:struct<first:int,words:int,text:string>>"

    def step(acc: Column, b: Column) -> Column:
        o = acc["open"]
        fresh = F.struct(b["block_ordinal"].alias("first"), b["words"].alias("words"), b["text"].alias("text"))
        closed = o.isNotNull() & ((o["words"] >= target) | (o["words"] + b["words"] > most))
        joined = F.struct(o["first"].alias("first"), (o["words"] + b["words"]).alias("words"), F.concat_ws("\n", o["text"], b["text"]).alias("text"))
        done = F.when(closed, F.array_append(acc["done"], o)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(closed | o.isNull(), fresh).otherwise(joined).alias("open")).cast(state)

    start = F.struct(F.array().cast("array<struct<first:int,words:int,text:string>>").alias("done"), F.lit(None).cast("struct<first:int,words:int,text:string>").alias("open")).cast(state)
    made = F.aggregate("bs", start, step, lambda a: F.array_append(a["done"], a["open"]))
    return rows.select(key, "section_ordinal", F.posexplode(made).alias("chunk_ordinal", "c")).select(key, "section_ordinal", "chunk_ordinal", F.col("c.first").alias("first_block"), "c.words", "c.text")


#: A token is a run of letters, a run of digits or a mark; kinds of blocks that stay with what is before them.
TOKEN = r"(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}])"
ATTACHED = ("figure_caption", "table_caption", "table_body_text")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1))


def pieces(blocks: DataFrame, key: str = "corpus_id", most: int = CHUNK_MOST) -> DataFrame:
    """key, section_ordinal, block_ordinal, block_kind, piece_ordinal, tokens, text: blocks of at most ``most`` tokens.

    A longer block is cut into sentences, and a longer sentence between tokens; no character but the space between
    sentences is lost. Blocks without a token go.
    """
    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    spaced = lambda x: F.regexp_extract_all(x, F.lit(rf"(\s*{TOKEN})"), 1)
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(spaced(x)) - 1) / most).cast("int")), lambda j: F.array_join(F.slice(spaced(x), j * most + 1, F.lit(most)), ""))
    refined = F.flatten(F.transform(sentences, lambda x: F.when(token_count(x) > most, runs(x)).otherwise(F.array(x))))
    cut = F.when(token_count(F.col("text")) > most, refined).otherwise(F.array("text"))
    rows = blocks.select(key, "section_ordinal", "block_ordinal", "block_kind", F.posexplode(cut).alias("piece_ordinal", "text"))
    return rows.withColumn("tokens", token_count(F.col("text"))).filter("tokens > 0")


def token_chunks(blocks: DataFrame, key: str = "corpus_id", target: int = CHUNK_TARGET, most: int = CHUNK_MOST) -> DataFrame:
    """key, section_ordinal, chunk_ordinal, first_block, last_block, tokens, text: neighbouring pieces of one section.

    A chunk closes once it has ``target`` tokens or the next piece would lead over ``most``; captions and bodies of
    tables still join one that has reached its target, as long as they fit, so that they stay with their context.
    No chunk has more than ``most`` tokens. A section's pieces are one row: sections are bounded by their document.
    """
    attached = F.col("block_kind").isin(*ATTACHED).alias("attached")
    rows = pieces(blocks, key, most).select(key, "section_ordinal", F.struct("block_ordinal", "piece_ordinal", "tokens", attached, "text").alias("b")).groupBy(key, "section_ordinal").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    chunk = "struct<first:int,last:int,tokens:int,text:string>"
    state = f"struct<done:array<{chunk}>,open:{chunk}>"

    def step(acc: Column, b: Column) -> Column:
        o = acc["open"]
        fresh = F.struct(b["block_ordinal"].alias("first"), b["block_ordinal"].alias("last"), b["tokens"].alias("tokens"), b["text"].alias("text"))
        closed = o.isNotNull() & ((o["tokens"] + b["tokens"] > most) | ((o["tokens"] >= target) & ~b["attached"]))
        between = F.when(o["last"] == b["block_ordinal"], " ").otherwise("\n")
        joined = F.struct(o["first"].alias("first"), b["block_ordinal"].alias("last"), (o["tokens"] + b["tokens"]).alias("tokens"), F.concat(o["text"], between, b["text"]).alias("text"))
        done = F.when(closed, F.array_append(acc["done"], o)).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(closed | o.isNull(), fresh).otherwise(joined).alias("open")).cast(state)

    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open")).cast(state)
    made = F.aggregate("bs", start, step, lambda a: F.array_append(a["done"], a["open"]))
    return rows.select(key, "section_ordinal", F.posexplode(made).alias("chunk_ordinal", "c")).select(key, "section_ordinal", "chunk_ordinal", F.col("c.first").alias("first_block"), F.col("c.last").alias("last_block"), "c.tokens", "c.text")


def evidence_kind(role: Column, block_kind: Column, is_window: Column | None = None) -> Column:
    """What a chunk, or a window of its sentences, is evidence of: by the section's role where it is prose."""
    prose = block_kind == "paragraph"
    kind = F.when(prose & (role == "abstract"), "abstract_conclusion").when(prose & (role == "results"), "results_paragraph").otherwise("paragraph")
    return kind if is_window is None else F.when(is_window, "sentence_window").otherwise(kind)


def contract_audit(texts: DataFrame, documents: DataFrame, blocks: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Per text: whether availability, document and blocks contradict each other."""
    counted = blocks.groupBy(key).agg(F.count("*").alias("block_count"))
    rows = texts.select(key, "text_availability").join(documents.select(key).distinct().withColumn("has_document", F.lit(True)), key, "left").join(counted, key, "left")
    has, n = F.coalesce("has_document", F.lit(False)), F.coalesce("block_count", F.lit(0))
    return rows.select(key, "text_availability", has.alias("has_document"), n.alias("block_count"), (has & (n == 0)).alias("document_without_blocks"), (~has & (n > 0)).alias("blocks_without_document"), ((F.col("text_availability") >= 2) & ~has).alias("stated_but_missing"))


def misplaced(annotations: DataFrame, source: int = 2) -> DataFrame:
    """Annotations of a source that states no places which have one all the same."""
    return annotations.filter((F.col("resource") == source) & ((F.col("start_offset") != 0) | (F.col("end_offset") != 0)))


def loaded_by(rows: DataFrame, runs: DataFrame, releases: DataFrame, names: list[str]) -> DataFrame:
    """Rows last seen by a run over a release of one of these sources."""
    own = runs.join(releases.filter(F.col("source_name").isin(names)).select("source_release_id"), "source_release_id", "left_semi")
    return rows.join(own.select(F.col("ingest_run_id").alias("last_seen_run_id")), "last_seen_run_id", "left_semi")


def bundle_eligible(status: DataFrame, embeddings: DataFrame, texts: DataFrame, model: int = 1) -> DataFrame:
    """corpus_id of mapped papers laid out, with an embedding of the model and a text."""
    ready = status.filter((F.col("domain_status") == "mapped") & F.col("layout_status").isin("mapped", "ready")).select("corpus_id")
    with_text = ready.join(texts.filter("text_availability >= 1").select("corpus_id"), "corpus_id", "left_semi")
    return with_text.join(embeddings.filter(F.col("model_key") == model).select("corpus_id"), "corpus_id", "left_semi")
