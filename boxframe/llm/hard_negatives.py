"""Hard-negative mining by a distributed nearest-neighbour join over Voronoi cells.

Vectors are scaled and floored to integers, so scores (inner products) are exact. A coordinate sqrt(M^2 - |x|^2), with M the
largest norm, is added to candidates and 0 to anchors; then a nearer candidate is one of larger score. Pivots, drawn
from a bounded sample, cut the space into Voronoi cells. Anchors form groups by cell, hot cells in several.

Both searches, for positives and for negatives, take two passes. In the first a candidate meets the anchor groups of its own cell only, which
gives each anchor a worst score that still counts. In the second it is replicated to those other groups that it might serve: with
R the largest distance of a group's anchors from the group's pivot p, no anchor of the group is nearer to the candidate than
|x' - p| - R nor farther than |x' - p| + R, which bounds the score from both sides. Groups meet their candidates in
blocks of bounded size, join them exactly, and keep the first K by score, then vec_id; the blocks' lists are merged by a ranked window.

Candidates of equal label and vector tie with each other, so only the few with the smallest vec_id can be returned: the others leave before any
join, by a ranked window whose limit Spark applies before the shuffle. A vector that a third of all rows have is a few candidates.

Defined results: rows with a null label, a null vector, a null or non-finite component or one of LARGEST or more after scaling (whose products
leave 64 bits) take no part; a vector shorter than others counts as continued by zeros; a null vec_id is no anchor and comes last in
ties; repeated rows count once, and rows that share only the vec_id are different rows that are never each other's
positives or negatives; an empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored

ship(__name__)

EVERY, SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 100, 256, 5, 10, 30, 90
LARGEST = 1 << 24
NO_ID = (1 << 63) - 1
#: Vectors and components of the sample that the pivots come from.
SAMPLE, SAMPLE_CELLS = 16_384, 1 << 22
#: Anchors for which there is one pivot; anchors of a group and candidates of a block at most, about.
PER_PIVOT, GROUP, BLOCK = 512, 1_024, 16_384
LEAST_PIVOTS, MOST_PIVOTS = 4, 65_536
#: Classes of labels by hash: a candidate for positives meets only groups of its class.
CLASSES = 64
FAR = 1e300
WIDE = "g long, block int, id long, label long, q array<{}>"


# -- vectors and cells ----------------------------------------------------------------------------


def vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, q (the scaled vector), h1, h2 (hashes of both): the distinct rows that take part."""
    rows = table.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("x"))
    fits = F.forall("x", lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)))  # also false for NaN, which is larger than any number
    rows = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & fits).select("id", "label", F.transform("x", lambda x: F.floor(x).cast("int")).alias("q"))
    return rows.withColumns({"h1": F.xxhash64("label", "q"), "h2": F.xxhash64(F.lit(1), "q", "label")}).dropDuplicates(["id", "h1", "h2"])


class Space:
    """The pivots of an augmented space: reach2 is the largest squared norm of a candidate."""

    def __init__(self, sample: np.ndarray, width: int, largest: int, reach2: float, pivots: int) -> None:
        self.width, self.reach2 = width, reach2
        self.exact = width * (largest + 1) ** 2 < 1 << 53
        points, draw = self.augmented(sample.reshape(-1, width).astype(float)), np.random.default_rng(11)
        self.pivots = points[draw.permutation(len(points))[:pivots]] if len(points) else np.zeros((1, width + 1))
        for _ in range(3):  # a few rounds of means make cells rounder
            home = self.distances(points).argmin(1) if len(points) else np.zeros(0, int)
            for k in np.unique(home):
                self.pivots[k] = points[home == k].mean(0)

    def augmented(self, x: np.ndarray, anchor: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if anchor else np.sqrt(np.maximum(0, self.reach2 - (x * x).sum(1)))
        return np.c_[x, rest]

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (points * points).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * points @ self.pivots.T))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold them below 2^53, else 64-bit integers."""
        kind = np.float64 if self.exact else np.int64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, width) if isinstance(lists, pa.ChunkedArray) else lists.flatten().to_numpy().reshape(-1, width)


def located(rows: DataFrame, space: Space, anchor: bool) -> DataFrame:
    """rows with cell, away (the distance to its pivot) and n2 (the squared norm)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("q"), space.width).astype(float)
            d = space.distances(space.augmented(q, anchor))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(1)), pa.array(d.min(1)), pa.array((q * q).sum(1))], [*b.schema.names, "cell", "away", "n2"])

    kind = rows.schema["q"].dataType.simpleString()
    return rows.select("id", "label", "q", "h1").mapInArrow(each, f"id long, label long, q {kind}, h1 long, cell long, away double, n2 double")


# -- the join -------------------------------------------------------------------------------------


def _grouped(anchors: DataFrame, by_label: bool) -> DataFrame:
    """anchors with kind (the class of labels, or 0) and g, a group of one cell and class."""
    kind = F.pmod(F.hash("label"), F.lit(CLASSES)) if by_label else F.lit(0)
    rows = anchors.withColumn("kind", kind.cast("long"))
    # At most CLASSES rows for each pivot: a proven bound for this broadcast.
    parts = F.broadcast(rows.groupBy("kind", "cell").agg(F.ceil(F.count("*") / GROUP).alias("parts")))
    rows = rows.join(parts, ["kind", "cell"])
    return rows.withColumn("g", F.xxhash64("kind", "cell", F.pmod(F.xxhash64("id", "h1"), "parts"))).drop("parts")


def _route(candidates: DataFrame, space: Space, groups: pd.DataFrame, blocks: int, by_label: bool, home: bool) -> DataFrame:
    """A row for each candidate and each group that it might serve: of its own cell (home), or of the others within bounds."""
    width, each = space.width, [tuple(x) for x in groups.itertuples(index=False)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column("q"), width)
            cell, kind, block = (b.column(c).to_numpy() for c in ("cell", "kind", "block"))
            d = None if home else space.distances(space.augmented(q.astype(float)))
            for g, at, of, radius, most, least, lo, hi in each:
                serves = cell == at if home else cell != at
                if by_label:
                    serves = serves & (kind == of)
                if not home:
                    slack = 1 + 1e-9 * (most + space.reach2)
                    upper = (most + space.reach2 - np.maximum(0, d[:, at] - radius) ** 2) / 2
                    lower = (least + space.reach2 - (d[:, at] + radius) ** 2) / 2
                    serves &= (upper + slack >= lo) & (lower - slack <= hi)
                idx = np.flatnonzero(serves)
                if len(idx):
                    rows = b.select(["id", "label", "q"]).take(pa.array(idx))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), g)), pa.array(block[idx]), *rows.columns], ["g", "block", "id", "label", "q"])

    kind = F.pmod(F.hash("label"), F.lit(CLASSES)).cast("long")
    rows = candidates.select("id", "label", "q", "cell", kind.alias("kind"), F.pmod(F.xxhash64("id", "h1"), F.lit(blocks)).cast("int").alias("block"))
    return rows.mapInArrow(routed, WIDE.format(candidates.schema["q"].dataType.elementType.simpleString()))


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first by score, then id."""
    idx = np.arange(len(scores))
    if len(scores) > 4 * k:
        idx = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return idx[np.lexsort((ids[idx], -scores[idx]))[:k]]


def _positives(space: Space, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        al, rl, aid, rid = left["label"].to_numpy(), right["label"].to_numpy(), left["id"].to_numpy(), right["id"].to_numpy()
        a, x, h = _matrix(left["q"], space.width), _matrix(right["q"], space.width), left["h1"].to_numpy()
        for label in np.intersect1d(al, rl):
            of, own = np.flatnonzero(al == label), np.flatnonzero(rl == label)
            for i, scores in zip(of, space.scores(a[of], x[own]), strict=True):
                other = np.flatnonzero(rid[own] != aid[i])
                best = other[_first(scores[other], rid[own][other], k)]
                out += [(aid[i], h[i], rid[own[j]], scores[j]) for j in best]
        cols = np.array(out, np.int64).reshape(-1, 4).T
        return pa.table(dict(zip(("anchor", "h1", "id", "score"), map(pa.array, cols), strict=True)))

    return found


def _negatives(space: Space, k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        al, rl, aid, rid = left["label"].to_numpy(), right["label"].to_numpy(), left["id"].to_numpy(), right["id"].to_numpy()
        a, x, h = _matrix(left["q"], space.width), _matrix(right["q"], space.width), left["h1"].to_numpy()
        wanted = left["positives"].to_pylist()
        for at in range(0, len(a), 64):  # a few anchors at a time: their scores take 8 MB for a block
            for i, scores in enumerate(space.scores(a[at : at + 64], x) if len(x) else (), at):
                least, most = (-(-low * min(p["score"] for p in wanted[i]) // 100), high * max(p["score"] for p in wanted[i]) // 100)
                own = np.flatnonzero((scores >= least) & (scores <= most) & (rl != al[i]) & (rid != aid[i]))
                order = own[np.lexsort((rid[own], -scores[own]))]
                falling = -scores[order]
                for n, p in enumerate(wanted[i]):
                    start = np.searchsorted(falling, -(high * p["score"] // 100), "left")
                    end = np.searchsorted(falling, low * -p["score"] // 100, "right")
                    out += [(aid[i], h[i], n, p["id"], p["score"], rid[j], scores[j]) for j in order[start : min(start + k, end)]]
        cols = np.array(out, np.int64).reshape(-1, 7).T
        return pa.table(dict(zip(("anchor", "h1", "n", "positive", "positive_score", "id", "score"), map(pa.array, cols), strict=True)))

    return found


def _join(anchors: DataFrame, candidates: DataFrame, space: Space, blocks: int, by_label: bool, home: bool, search: Callable, schema: str) -> DataFrame:
    """search(anchors, candidates) over every group (anchors with kind, g, lo, hi) and block of candidates that might serve it."""
    ends = anchors.groupBy("g").agg(F.first("cell"), F.first("kind"), F.max("away"), F.max("n2"), F.min("n2"), F.min("lo"), F.max("hi"))
    routed = _route(candidates, space, ends.toPandas(), blocks, by_label, home)
    left = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("g", "block").cogroup(routed.groupBy("g", "block")).applyInArrow(search, schema)


def _ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows by score, then id, of each key, with rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _two_passes(anchors: DataFrame, candidates: DataFrame, space: Space, blocks: int, by_label: bool, search: Callable, schema: str, by: list[str], k: int, limits: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What the home pass and the bounded pass find together (a stored table); limits(found) gives anchors with lo and hi."""
    first = stored(_ranked(_join(anchors, candidates, space, blocks, by_label, True, search, schema), by, k).drop("rank"), f"{name}_home")
    rest = _join(stored(limits(first), f"{name}_limits"), candidates, space, blocks, by_label, False, search, schema)
    return stored(_ranked(first.unionByName(rest), by, k), name)


def mine(table: DataFrame, anchor: Column | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of table (vec_id, embedding, label) that are anchors.

    anchor is a condition on id (default: a vec_id that EVERY divides). Negatives score between low and high percent of the positive.
    """
    anchor = F.col("id") % EVERY == 0 if anchor is None else anchor
    rows = stored(vectors(table, scale), "vectors")
    anchor = (F.col("id") != NO_ID) & anchor
    squares = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    total = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("q")), F.max(F.array_max(F.transform("q", F.abs))), F.max(squares)).first()
    count, n_anchors, width, largest, reach2 = (x or 0 for x in total)
    width = max(1, width)
    q = F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q")))
    rows = rows.withColumn("q", q.cast("array<smallint>") if largest < 1 << 15 else q)
    pivots = max(LEAST_PIVOTS, min(MOST_PIVOTS, -(-n_anchors // PER_PIVOT)))
    sample = rows.select("q", F.xxhash64("h1", "id").alias("r")).orderBy("r").limit(min(SAMPLE, max(pivots, SAMPLE_CELLS // width))).toPandas().q
    space = Space(np.stack(sample) if len(sample) else np.zeros((0, width)), width, largest, float(reach2), pivots)
    blocks = max(1, -(-count // BLOCK))

    copies = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives))
    candidates = stored(located(few, space, False), "candidates")
    anchors = stored(located(rows.where(anchor), space, True), "anchors")

    own = ["anchor", "h1"]
    a = stored(_grouped(anchors, True).withColumns({"lo": F.lit(-FAR), "hi": F.lit(FAR)}), "positive_groups")

    def fifth(found: DataFrame) -> DataFrame:
        worst = found.groupBy(F.col("anchor").alias("id"), "h1").agg(F.when(F.count("*") >= positives, F.min("score")).alias("worst"))
        return a.join(worst, ["id", "h1"], "left").withColumn("lo", F.coalesce(F.col("worst").cast("double"), F.lit(-FAR))).drop("worst")

    found = _two_passes(a, candidates, space, blocks, True, _positives(space, positives), "anchor long, h1 long, id long, score long", own, positives, fifth, "positives")
    # A band of a negative score is empty. At most `positives` rows for each anchor are gathered.
    lists = found.where("score >= 0").groupBy(F.col("anchor").alias("id"), "h1").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score"))).alias("positives"))
    band = {"lo": F.array_min(F.transform("positives", lambda p: p["score"])) * (low / 100), "hi": F.array_max(F.transform("positives", lambda p: p["score"])) * (high / 100)}
    b = stored(_grouped(anchors, False).join(lists, ["id", "h1"]).withColumns(band), "negative_groups")

    def tenth(found: DataFrame) -> DataFrame:
        full = found.groupBy(F.col("anchor").alias("id"), "h1", "n").agg(F.count("*").alias("have"), F.min("score").alias("least")).where(F.col("have") >= negatives)
        worst = full.groupBy("id", "h1").agg(F.count("*").alias("bands"), F.min("least").alias("worst"))
        return b.join(worst, ["id", "h1"], "left").withColumn("lo", F.when(F.col("bands") == F.size("positives"), F.col("worst").cast("double")).otherwise(F.col("lo"))).drop("bands", "worst")

    schema = "anchor long, h1 long, n long, positive long, positive_score long, id long, score long"
    out = _two_passes(b, candidates, space, blocks, False, _negatives(space, negatives, low, high), schema, [*own, "n"], negatives, tenth, "negatives")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(F.col("anchor").alias("anchor_id"), known("positive").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
