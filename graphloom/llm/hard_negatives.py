"""Hard negatives by product quantisation with stored residual norms.

A vector is cut into parts; each part is coded by the nearest of at most 256 centroids, and the length of
what the centroid leaves of it, the residual, is stored beside the code. For an anchor, a table of the products
of its parts with all centroids gives an approximate score by look-up; the true one differs by at most the sum,
over the parts, of the anchor's length times the residual's (Cauchy-Schwarz). These bounds decide which rows
can be among the first: those whose upper bound reaches the k-th best lower bound. Only they are
scored again, in exact integers, so results do not depend on the centroids.

Rows lie in groups of one dimension and one label, of a bounded size. Anchors are sent to the groups of their
label, which gives positives, and then with these to all other groups, which gives what lies in each positive's
window. Each group returns its few best for each anchor; a ranking over groups completes the answer. Centroids are
fitted on at most ``SAMPLE`` rows, those of smallest hash; every row is coded.

Rows with a null key or label, a null vector, or a null or non-finite component take no part; nor do vectors
longer than 2^31 once scaled, whose products could leave 64 bits. Vectors of other dimensions are not
compared. Rows of one key are different rows: each is an anchor, a positive or a negative of its own. Ties
go to the smaller key. An anchor without positives, and a positive without negatives in its window, give no rows,
as does an empty table. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import require, stored
from graphloom.llm.topk import integer_components

#: Rows on which centroids are fitted, parts of a vector, centroids of a part, rounds of fitting.
SAMPLE, PARTS, CENTROIDS, ROUNDS = 16_384, 8, 256, 8
#: Rows in a group, anchors that meet it at once, anchors that one task compares with it.
GROUP, BLOCK, STRIPE = 32_768, 128, 65_536
#: Vectors up to this length have products that fit 64 bits.
LONGEST = 2.0**31

Codebook = dict[int, list[tuple[slice, np.ndarray]]]


def slices(dim: int) -> list[slice]:
    """The parts of a vector."""
    edges = np.linspace(0, dim, min(PARTS, max(dim, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def nearest(part: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return np.argmin((centroids**2).sum(1) - 2 * (part @ centroids.T), axis=1)


def fit(sample: list[np.ndarray]) -> Codebook:
    """Centroids of each part, by dimension, from Lloyd's rounds."""
    book: Codebook = {}
    for dim in {len(v) for v in sample}:
        rows = np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim)
        picked = np.random.default_rng(7).permutation(len(rows))[:CENTROIDS]
        book[dim] = []
        for cut in slices(dim):
            part = rows[:, cut]
            centroids = part[picked].copy()
            for _ in range(ROUNDS):
                at = nearest(part, centroids)
                sums = np.zeros_like(centroids)
                np.add.at(sums, at, part)
                counts = np.bincount(at, minlength=len(centroids))
                centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
            book[dim].append((cut, centroids))
    return book


def centroids_of(book: Codebook, dim: int) -> list[tuple[slice, np.ndarray]]:
    """Those of a dimension; one that the sample lacked has the zero vector alone, so residuals are whole parts."""
    return book.get(dim) or [(cut, np.zeros((1, cut.stop - cut.start))) for cut in slices(dim)]


def coded(vectors: np.ndarray, parts: list[tuple[slice, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and residual lengths of each vector's parts."""
    codes, residuals = [], []
    for cut, centroids in parts:
        at = nearest(vectors[:, cut], centroids)
        codes.append(at.astype(np.uint8))
        residuals.append(np.sqrt(((vectors[:, cut] - centroids[at]) ** 2).sum(1)))
    return np.stack(codes, 1), np.stack(residuals, 1)


class Group:
    """Rows of one dimension and label, with their codes."""

    def __init__(self, rows: pd.DataFrame, book: Codebook) -> None:
        dim = int(rows["dim"].iloc[0])
        self.ids, self.uids = rows["id"].to_numpy(), rows["uid"].to_numpy()
        self.vectors = np.frombuffer(b"".join(rows["content"]), "<i8").reshape(len(rows), dim)
        self.parts = centroids_of(book, dim)
        self.codes = np.frombuffer(b"".join(rows["codes"]), "u1").reshape(len(rows), -1).T.astype(np.intp)
        self.residuals = np.frombuffer(b"".join(rows["residuals"]), "<f8").reshape(len(rows), -1)
        self.longest = float(np.sqrt((self.vectors.astype(float) ** 2).sum(1)).max())

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the products of anchors and rows are at least and at most."""
        anchors = anchors.astype(float)
        about = np.zeros((len(anchors), len(self.ids)))
        lengths = []
        for (cut, centroids), codes in zip(self.parts, self.codes, strict=True):
            about += (anchors[:, cut] @ centroids.T)[:, codes]
            lengths.append(np.sqrt((anchors[:, cut] ** 2).sum(1)))
        own = np.stack(lengths, 1)
        # Beside the residuals, rounding: a part in 10^9 of the greatest product.
        spread = own @ self.residuals.T + (1e-6 + 1e-9 * self.longest * np.sqrt((own**2).sum(1)))[:, None]
        return about - spread, about + spread

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ anchor

    def first(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places, in ``at``, of the k best: by score, then key."""
        return np.lexsort((self.uids[at], self.ids[at], -scores))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value; no bound if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def positives_in(group: Group, asking: pd.DataFrame, k: int) -> list[tuple]:
    """(anchor, score, key, row) of the k best other rows of the group for each anchor."""
    anchors = np.frombuffer(b"".join(asking["content"]), "<i8").reshape(len(asking), -1)
    lower, upper = group.bounds(anchors)
    out = []
    for q, uid in enumerate(asking["uid"].to_numpy()):
        other = group.uids != uid
        at = np.flatnonzero(other & (upper[q] >= kth(lower[q][other], k)))
        scores = group.exact(anchors[q], at)
        out += [(uid, int(scores[i]), int(group.ids[at[i]]), int(group.uids[at[i]])) for i in group.first(at, scores, k)]
    return out


def negatives_in(group: Group, asking: pd.DataFrame, k: int, low: int, high: int) -> list[tuple]:
    """(anchor, positive, score, key, row) of the k best rows of the group in the window of each anchor's positives."""
    anchors = np.frombuffer(b"".join(asking["content"]), "<i8").reshape(len(asking), -1)
    lower, upper = group.bounds(anchors)
    out = []
    for q, (uid, positives) in enumerate(zip(asking["uid"].to_numpy(), asking["positives"], strict=True)):
        windows = []
        for p in positives:
            least, most = -(-low * p["score"] // 100), high * p["score"] // 100
            if least <= most:
                sure = (lower[q] >= least) & (upper[q] <= most)
                enough = max(least, kth(lower[q][sure], k))
                windows.append((p["uid"], least, most, np.flatnonzero((upper[q] >= enough) & (lower[q] <= most))))
        if not windows:
            continue
        at = np.unique(np.concatenate([w[3] for w in windows]))
        scores = group.exact(anchors[q], at)
        for positive, least, most, candidates in windows:
            mine = np.searchsorted(at, candidates)
            mine = mine[(scores[mine] >= least) & (scores[mine] <= most)]
            out += [(uid, int(positive), int(scores[i]), int(group.ids[at[i]]), int(group.uids[at[i]])) for i in mine[group.first(at[mine], scores[mine], k)]]
    return out


_ROW = "group long, dim int, label long, uid long, id long, content binary, codes binary, residuals binary"


def quantised(rows: DataFrame, book: Codebook) -> DataFrame:
    """Rows (id, label, v) with numbers of their own, in groups of one dimension and label; a stored table."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        group, kind, held = number, None, 0
        for batch in batches:
            for (dim, label), part in batch.assign(dim=[len(v) for v in batch["v"]]).groupby(["dim", "label"], sort=False):
                vectors = np.array(part["v"].tolist(), float).reshape(len(part), dim)
                codes, residuals = coded(vectors, centroids_of(book, int(dim)))
                groups = []
                for _ in range(len(part)):
                    if kind != (dim, label) or held == GROUP:
                        group, kind, held = group + 1, (dim, label), 0
                    held += 1
                    groups.append(group)
                content = vectors.astype("<i8")
                uids = np.arange(number, number + len(part))
                number += len(part)
                yield pd.DataFrame({"group": groups, "dim": dim, "label": label, "uid": uids, "id": part["id"].to_numpy(), "content": [c.tobytes() for c in content], "codes": [c.tobytes() for c in codes], "residuals": [r.astype("<f8").tobytes() for r in residuals]})

    order = [F.size("v"), "label", "id"]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(task, _ROW), "quantised")


def met(rows: DataFrame, asking: DataFrame, stripes: int, book: Codebook, search: Callable[[Group, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """What ``search`` finds for anchors (with their ``group`` to meet) in the groups of rows.

    A task takes a group whole, which is bounded, and then lets anchors pass in blocks.
    """
    columns = ["group", "stripe", "asks", "dim", "uid", "id", "content", "codes", "residuals", "positives"]
    none = F.lit(None).cast("array<struct<score:bigint,id:bigint,uid:bigint>>")
    held = rows.withColumns({"stripe": F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))), "asks": F.lit(0), "positives": none})
    passing = asking.withColumns({"stripe": (F.pmod(F.xxhash64("uid"), F.lit(stripes))).cast("int"), "asks": F.lit(1), "codes": F.lit(None).cast("binary"), "residuals": F.lit(None).cast("binary")})
    if "positives" not in asking.columns:
        passing = passing.withColumn("positives", none)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        at, parts, group = None, [], None
        for batch in batches:
            for key, part in batch.groupby(["group", "stripe"], sort=False):
                if key != at:
                    at, parts, group = key, [], None
                is_asking = part["asks"].to_numpy() == 1
                if not is_asking.all():
                    parts.append(part[~is_asking])
                asked = part[is_asking]
                if len(asked) and group is None:
                    group, parts = Group(pd.concat(parts), book), []
                for start in range(0, len(asked), BLOCK):
                    found = search(group, asked[start : start + BLOCK])
                    if found:
                        yield pd.DataFrame(found, columns=names)

    both = held.select(*columns).unionByName(passing.select(*columns))
    return both.repartition("group", "stripe").sortWithinPartitions("group", "stripe", "asks").mapInPandas(task, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int, negatives: int, low: int, high: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose
    score is between ``low`` and ``high`` percent of the positive's: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. ``is_anchor`` may use the columns ``id`` and ``label``."""
    require(vectors, (key, vector, label))
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(key).isNotNull() & F.col(label).isNotNull()
    scaled = vectors.filter(usable).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), integer_components(F.col(vector), scale).alias("v"))
    rows = scaled.filter(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) <= LONGEST**2)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()
    book = fit([np.array(r["v"]) for r in sample])
    table = quantised(rows, book)
    anchors = table.filter(is_anchor).drop("codes", "residuals")
    stripes = 1 + anchors.count() // STRIPE
    groups = table.select("group", "dim", "label").distinct()

    own = groups.join(anchors.drop("group"), ["dim", "label"])
    best = met(table, own, stripes, book, lambda g, a: positives_in(g, a, positives), "anchor long, score long, id long, uid long")
    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "uid")
    chosen = stored(best.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= positives).groupBy("anchor").agg(F.collect_list(F.struct("score", "id", "uid")).alias("positives")), "positives")

    asking = anchors.drop("group").join(chosen.withColumnRenamed("anchor", "uid"), "uid")
    others = groups.withColumnRenamed("label", "other").join(asking, "dim").filter(F.col("label") != F.col("other")).drop("other")
    found = met(table, others, stripes, book, lambda g, a: negatives_in(g, a, negatives, low, high), "anchor long, positive long, score long, id long, uid long")
    ranked = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id", "uid")
    first = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    named = asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor", "anchor_id", F.col("p.uid").alias("positive"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return first.join(named, ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
