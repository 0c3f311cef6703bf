"""Retrieval: word and vector scores, fusion, promotion to parents, dictionary matches.

A stated set of queries meets all rows in blocks; every task keeps its own best few before anything is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.files import kept

#: Vectors of a pack, and what ranks are added to before they are fused.
PACKED, RANK_CONSTANT = 1024, 60
K1, B = 1.2, 0.75
#: Terms of a dictionary that one automaton holds.
TERMS = 200_000
_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _WORD), "")


def bm25(documents: DataFrame, terms: list[str], fields: dict[str, float], key: str = "id") -> DataFrame:
    """key, score of documents that hold one of the terms; fields add up by weight.

    Each field has its own mean length and document frequencies, over all documents.
    """
    terms = sorted({t.lower() for t in terms})
    found = None
    for name, weight in fields.items():
        rows = documents.select(key, words(F.coalesce(name, F.lit(""))).alias("w"))
        counted = rows.select(key, F.size("w").alias("size"), *((F.size("w") - F.size(F.array_remove("w", t))).alias(f"tf{i}") for i, t in enumerate(terms)))
        stats = counted.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
        n, mean = stats["n"], stats["mean"] or 1.0
        score = F.lit(0.0)
        for i in range(len(terms)):
            idf = float(np.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
            tf = F.col(f"tf{i}").cast("double")
            score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / mean))
        hit = counted.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).select(key, (score * weight).alias("score"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(key).agg(F.sum("score").alias("score"))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, v) as packs: ids and a matrix of doubles, one for each batch that a task reads."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PACKED):
                part = batch[at : at + PACKED]
                matrix = np.stack(part["v"].to_numpy()).astype("<f8")
                unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"ids": [part[key].tolist()], "units": [unit.tobytes()]})

    return rows.mapInPandas(task, "ids array<long>, units binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank of the k highest cosines for each query, ties to the smaller key.

    Queries (query_id, vector) and vectors meet in blocks, pack by pack, so neither comes to the driver and there may
    be any number of both. A pair of packs returns at most k rows for each query.
    """
    doubles = lambda df, name: df.select(F.col(name).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    asked = kept(packed(doubles(queries, "query_id"), "query_id"), "query-packs")
    # A stated query set against all rows, in blocks: one row for each pair of packs.
    pairs = packed(doubles(vectors, key), key).crossJoin(asked.select(F.col("ids").alias("q_ids"), F.col("units").alias("q_units")))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                keys, names = np.asarray(row.ids), np.asarray(row.q_ids)
                scores = np.frombuffer(row.q_units).reshape(len(names), -1) @ np.frombuffer(row.units).reshape(len(keys), -1).T
                for q, own in zip(names, scores, strict=True):
                    best = np.lexsort((keys, -own))[: k + 1]
                    best = best[keys[best] != q][:k]
                    yield pd.DataFrame({"query_id": np.full(len(best), q), key: keys[best], "score": own[best]})

    found = pairs.select("ids", "units", "q_ids", "q_units").mapInPandas(scored, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(scores: DataFrame, group: list[str], k: int, key: str = "id") -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), key) if group else Window.orderBy(F.desc("score"), key)
    first = scores if group else scores.orderBy(F.desc("score"), key).limit(k)
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fused(channels: list[DataFrame], key: str = "id", constant: int = RANK_CONSTANT, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of channels (key, rank): the sum of weight / (constant + rank)."""
    rows = None
    for channel, weight in zip(channels, weights or [1.0] * len(channels), strict=True):
        part = channel.select(key, (F.lit(weight) / (F.lit(constant) + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.sum("part").alias("score"), F.count("*").alias("channels"))


def min_max(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0..1; 1 where all are equal."""
    ends = scores.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    scaled = F.coalesce(F.try_divide(F.col("score") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(1.0))
    return scores.crossJoin(F.broadcast(ends)).withColumn("score", scaled).drop("_low", "_high")


def mean_of(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """The mean of two scaled channels; what a channel lacks counts as 0."""
    both = min_max(a.select(key, "score")).withColumnRenamed("score", "_a").join(min_max(b.select(key, "score")).withColumnRenamed("score", "_b"), key, "full_outer")
    return both.select(key, ((F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).alias("score"))


def promoted(chunks: DataFrame, parent: str, k: int, per_parent: int = 3, key: str = "chunk_id") -> DataFrame:
    """Parents by their best chunk, with up to three chunks each."""
    order = Window.partitionBy(parent).orderBy(F.desc("score"), key)
    few = chunks.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_parent)
    best = few.groupBy(parent).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("_n", key))).alias("c"))
    return best.select(parent, "score", F.transform("c", lambda x: x[key]).alias("chunks")).orderBy(F.desc("score"), parent).limit(k)


def mentions(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", term: str = "matched_text", entity: str = "entity_id") -> DataFrame:
    """key, entity, at: where each entity of a dictionary is first named, as whole words in any case.

    Texts are read once by an Aho-Corasick automaton of the terms, so a text costs its length and what it names,
    however many terms there are. A dictionary of more than ``TERMS`` terms is cut into shards of that size, and texts meet
    one after the other; a task holds the automaton of one shard.
    """
    terms = kept(dictionary.select(F.col(entity).alias("entity"), words(F.col(term)).alias("t")).filter(F.size("t") > 0).select("entity", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("term")).distinct(), "terms")
    shards = 1 + terms.count() // TERMS
    spread = texts.select(F.col(key).alias("key"), F.concat(F.lit(" "), F.array_join(words(F.coalesce(text, F.lit(""))), " "), F.lit(" ")).alias("line"))
    kinds = {"key": texts.schema[key].dataType.simpleString(), "entity": dictionary.schema[entity].dataType.simpleString()}
    schema = f"key {kinds['key']}, entity {kinds['entity']}, at int"
    if shards == 1:
        # At most TERMS terms, whole in every worker.
        known: dict[str, list] = {}
        for row in terms.collect():
            known.setdefault(row["term"], []).append(row["entity"])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(known)
            for batch in batches:
                yield _named(automaton, batch.column("key").to_pylist(), batch.column("line"), schema)

        found = spread.mapInArrow(read, schema)
    else:
        stripes = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        held = terms.select(F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), every(stripes).alias("stripe"), F.lit(0).alias("kind"), "entity", "term", F.lit(None).cast(kinds["key"]).alias("key"))
        passing = spread.select(every(shards).alias("shard"), F.pmod(F.xxhash64("key", "line"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(1).alias("kind"), F.lit(None).cast(kinds["entity"]).alias("entity"), F.col("line").alias("term"), "key")

        def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, own, automaton = None, {}, None
            for batch in batches:
                # Runs of one shard, stripe and kind; terms come before texts.
                names = list(zip(*(batch.column(c).to_pylist() for c in ("shard", "stripe", "kind")), strict=True))
                starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
                for start, end in zip(starts, [*starts[1:], len(names)], strict=True):
                    part = batch.slice(start, end - start)
                    if names[start][:2] != at:
                        at, own, automaton = names[start][:2], {}, None
                    if names[start][2] == 0:
                        for t, e in zip(part.column("term").to_pylist(), part.column("entity").to_pylist(), strict=True):
                            own.setdefault(t, []).append(e)
                    elif own:
                        automaton = automaton or _automaton(own)
                        yield _named(automaton, part.column("key").to_pylist(), part.column("term"), schema)

        found = held.unionByName(passing).repartition("shard", "stripe").sortWithinPartitions("shard", "stripe", "kind").mapInArrow(sharded, schema)
    return found.groupBy("key", "entity").agg(F.min("at").alias("at")).select(F.col("key").alias(key), F.col("entity").alias(entity), "at")


#: Kinds of keys and entities.
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _automaton(terms: dict[str, list]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term, entities in terms.items():
        automaton.add_word(term, (len(term), entities))
    automaton.make_automaton()
    return automaton


def _named(automaton: ahocorasick.Automaton, keys: list, lines: pa.Array, schema: str) -> pa.RecordBatch:
    """key, entity, at of the first place of each entity in each line of words."""
    out: list[tuple] = []
    for key, line in zip(keys, lines, strict=True):
        first: dict = {}
        line = line.as_py()
        for end, (size, entities) in automaton.iter(line):
            for entity in entities:
                start = end + 1 - size
                if start < first.get(entity, len(line)):
                    first[entity] = start
        if first:
            # The words before a place are the spaces before it.
            places, begin, count = {}, 0, 0
            for start in sorted(set(first.values())):
                count, begin = count + line.count(" ", begin, start), start
                places[start] = count
            out += [(key, entity, places[start]) for entity, start in first.items()]
    types = [_ARROW[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "entity", "at"])


def backlinks(pages: DataFrame, slug: str = "slug", links: str = "links") -> DataFrame:
    """slug, linked_from: pages that link to a page that exists."""
    out = pages.select(F.col(slug).alias("linked_from"), F.explode(F.array_distinct(links)).alias(slug))
    return out.join(pages.select(slug), slug, "left_semi")


def cards(papers: DataFrame, members: DataFrame, texts: DataFrame, metrics: DataFrame, venues: DataFrame, authors: DataFrame, key: str = "corpus_id") -> DataFrame:
    """A card for each member: counts, year, tier, availability, title, authors in order, venue and outer ids as JSON."""
    lines = authors.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("author_ordinal", "display_name"))), lambda a: a["display_name"]), ", ").alias("author_line"))
    rows = papers.join(members.select(key, "package_tier"), key)
    for more in (texts.select(key, "text_availability", "title"), metrics.select(key, "citation_in_count", "influential_citation_count"), lines):
        rows = rows.join(more, key, "left")
    rows = rows.join(venues.select("venue_id", F.col("display_name").alias("venue_display")), "venue_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    ids = F.to_json(F.struct(F.col("pmid"), F.col("doi_norm").alias("doi"), F.col("pmc_id").alias("pmc"), F.col("s2_paper_id").alias("s2")), {"ignoreNullFields": "false"})
    return rows.select(
        key, none("citation_in_count").alias("citation_count"), none("influential_citation_count").alias("influential_citation_count"), F.col("year").alias("publication_year"), none("package_tier").alias("package_tier"),
        none("text_availability").alias("text_availability"), F.col("title").alias("display_title"), "author_line", "venue_display", ids.alias("external_ids"),
    )


def entity_matches(texts: DataFrame, dictionary: DataFrame, limit: int, types: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """Per text, the first ``limit`` entities it names (of these types): key, entity_id, entity_type, at, score.

    The score is the share of the text's words before which the entity is named; the earlier, the higher.
    """
    wanted = dictionary if types is None else dictionary.filter(F.col("entity_type").isin(types))
    found = mentions(texts, wanted, key).join(wanted.select("entity_id", "entity_type").distinct(), "entity_id")
    sizes = texts.select(key, F.size(words(F.coalesce("text", F.lit("")))).alias("size"))
    scored = found.join(sizes, key).select(key, "entity_id", "entity_type", "at", (1 - F.col("at") / F.col("size")).alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def answer_sync(references: DataFrame, *stores: tuple[str, DataFrame], key: str = "id") -> DataFrame:
    """The papers an answer refers to, each once, with where each is drawn: ``active``, ``promoted`` from a wider store, or ``evidence_only``.

    The first of ``stores`` holds what is drawn already, the others what can be added.
    """
    from graphloom.operators.scope import availability

    first = stores[0][0]
    placed = availability(references.filter(F.trim(key) != ""), *stores, key=key)
    return placed.withColumn("role", F.when(F.col("store") == first, "active").when(F.col("store") == "missing", "evidence_only").otherwise("promoted"))
