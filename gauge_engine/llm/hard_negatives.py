"""Hard negatives: rows of another label that score nearly as high as an anchor's positives.

Rows are integer vectors; a row's score is its inner product with the anchor. The search is
exact and runs by angles:

1. A few reference directions are picked from a bounded sample. They decide speed only.
2. Every task sorts its rows by nearest reference and angle to it and cuts them into blocks.
   A block stores the window of its rows' angles to every reference, and of their norms.
3. For an anchor and a block, the triangle inequality of angles turns the anchor's angle and
   the block's window at each reference into an interval of the cosine; times the norms, and
   rounded outwards, it bounds every score in the block. Blocks whose interval does not
   reach the scores that are still wanted are left; the others are scored as integers.
4. This is done twice: for the highest scores within the label (positives), and for the
   highest of the other labels inside the window that each positive allows.

Anchors and blocks meet in a grid of tasks: groups of anchors times groups of blocks, both of
bounded size. No group follows a label or a cluster, so hot labels and copies do not pile up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gauge_engine.llm.shipping import ship_package
from gauge_engine.session import materialize

# References are picked by farthest-first traversal of so many rows with the smallest hash.
SAMPLE_ROWS = 1024
REFERENCES = 16
BLOCK_ROWS = 256
# Most anchors and rows that meet in one task.
ANCHORS_PER_TASK = 1 << 16
ROWS_PER_TASK = 1 << 18
# Row groups while they are small: anchors travel once per row group.
ROW_GROUPS = 64
ANCHORS_AT_ONCE = 1024

# Angles are true to about 3e-8 where the cosine is near 1 or -1.
ANGLE_SLACK = 1e-6
NO_ID = np.iinfo("i8").max
NO_SCORE = np.iinfo("i8").min

_BLOCKS = (
    "ids binary, labels binary, vectors binary, width int, dims int, "
    "angles_from array<double>, angles_to array<double>, norm_from double, norm_to double"
)
_ANCHORS = "anchor_key bigint, anchor_id bigint, label bigint, vector binary, norm double, angles array<double>"
_FOUND = "anchor_key bigint, slot int, id bigint, score bigint"


def quantized(values: np.ndarray, lengths: np.ndarray, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``; shorter rows end in zeros."""
    dims = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = np.floor(scale * values)
    if len(out) and (np.abs(out).max(initial=0) >= 2**62 or np.square(out).sum(axis=1).max() >= 2.0**62):
        raise ValueError("a vector is so long that its scores may not fit in 64 bits")
    return out.astype("i8")


def _padded(rows: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, dims - rows.shape[1])))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in the fastest type that holds every sum.

    No partial sum is larger than the product of the norms.
    """
    dims = max(left.shape[1], right.shape[1])
    left, right = _padded(left, dims), _padded(right, dims)
    top = np.sqrt(np.square(left.astype("f8")).sum(axis=1).max(initial=0) * np.square(right.astype("f8")).sum(axis=1).max(initial=0))
    kind = "f4" if top < 2**23 else "f8" if top < 2**52 else "i8"
    return (left.astype(kind) @ right.astype(kind).T).astype("i8")


def angles_to(references: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Angle of every row to every reference; 0 for rows without a direction."""
    dims = max(references.shape[1], rows.shape[1])
    rows, references = _padded(rows.astype("f8"), dims), _padded(references.astype("f8"), dims)
    norms = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(references, axis=1)
    cosines = np.divide(rows @ references.T, norms, out=np.ones(norms.shape), where=norms > 0)
    return np.arccos(np.clip(cosines, -1, 1))


def farthest_first(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each as far in angle from those before it as any."""
    rows = rows[np.any(rows != 0, axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]), "i8")
    picked, nearest = [0], angles_to(rows[:1], rows)[:, 0]
    while len(picked) < count and nearest.max() > ANGLE_SLACK:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, angles_to(rows[picked[-1:]], rows)[:, 0])
    return rows[picked]


def score_bounds(anchor_angles: np.ndarray, anchor_norms: np.ndarray, blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of every anchor in every block, rounded outwards."""
    low = np.zeros((len(anchor_norms), len(blocks)))
    high = np.full(low.shape, np.pi)
    starts = np.array(blocks["angles_from"].tolist()).reshape(len(blocks), -1)
    ends = np.array(blocks["angles_to"].tolist()).reshape(len(blocks), -1)
    for own, start, end in zip(anchor_angles.T, starts.T, ends.T):
        own = own[:, None]
        low = np.maximum(low, np.maximum(start - own, own - end))
        high = np.minimum(high, np.minimum(own + end, 2 * np.pi - own - start))
    top = np.cos(np.maximum(low - ANGLE_SLACK, 0))
    bottom = np.cos(np.minimum(high + ANGLE_SLACK, np.pi))
    longest, shortest = blocks["norm_to"].to_numpy(), blocks["norm_from"].to_numpy()
    norms = anchor_norms[:, None]
    slack = 1 + 1e-9 * norms * longest
    most = norms * np.where(top >= 0, longest, shortest) * top + slack
    least = norms * np.where(bottom >= 0, shortest, longest) * bottom - slack
    return least, most


def _make_blocks(batches: Iterator[pa.RecordBatch], references: np.ndarray, scale: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, labels, lists = (batch.column(k) for k in range(3))
        lengths = np.diff(lists.offsets.to_numpy())
        vectors = quantized(lists.flatten().to_numpy(zero_copy_only=False), lengths, scale)
        ids = ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("i8")
        labels = labels.to_numpy(zero_copy_only=False).astype("i8")
        angles = angles_to(references, vectors)
        norms = np.linalg.norm(vectors.astype("f8"), axis=1)
        near = angles.argmin(axis=1) if len(references) else np.zeros(len(ids), int)
        own = angles[np.arange(len(ids)), near] if len(references) else norms
        order = np.lexsort((ids, own, near))
        width = 2 if np.abs(vectors).max(initial=0) < 1 << 15 else 8
        rows = []
        for at in range(0, len(order), BLOCK_ROWS):
            part = order[at : at + BLOCK_ROWS]
            rows.append((
                ids[part].tobytes(), labels[part].tobytes(), vectors[part].astype(f"<i{width}").tobytes(), width, vectors.shape[1],
                angles[part].min(axis=0), angles[part].max(axis=0), norms[part].min(), norms[part].max(),
            ))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])


@dataclass
class Targets:
    """What is searched: for an anchor the ``count`` highest scores in ``least`` to ``most``."""

    anchor: np.ndarray
    least: np.ndarray
    most: np.ndarray
    count: int
    same_label: bool

    def __post_init__(self) -> None:
        self.scores = np.full((len(self.anchor), self.count), NO_SCORE)
        self.ids = np.full((len(self.anchor), self.count), NO_ID)

    def floor(self) -> np.ndarray:
        """The lowest score that can still enter: equal scores may, by their id."""
        return np.maximum(self.least, self.scores[:, -1])

    def add(self, target: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Enter candidates; one of equal score and id counts once."""
        touched = np.unique(target)
        held = self.scores[touched] != NO_SCORE
        target = np.concatenate([np.repeat(touched, held.sum(axis=1)), target])
        scores = np.concatenate([self.scores[touched][held], scores])
        ids = np.concatenate([self.ids[touched][held], ids])
        order = np.lexsort((ids, -scores, target))
        target, scores, ids = target[order], scores[order], ids[order]
        new = np.ones(len(target), bool)
        new[1:] = (target[1:] != target[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        target, scores, ids = target[new], scores[new], ids[new]
        begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        place = np.arange(len(target)) - np.repeat(begins, np.diff(np.append(begins, len(target))))
        fits = place < self.count
        self.scores[touched], self.ids[touched] = NO_SCORE, NO_ID
        self.scores[target[fits], place[fits]] = scores[fits]
        self.ids[target[fits], place[fits]] = ids[fits]


def scan(anchors: pd.DataFrame, vectors: np.ndarray, blocks: pd.DataFrame, targets: Targets) -> int:
    """Fill ``targets`` from the blocks; how many (anchor, block) pairs were scored."""
    least, most = score_bounds(np.array(anchors["angles"].tolist()).reshape(len(anchors), -1), anchors["norm"].to_numpy(), blocks)
    anchor_ids, anchor_labels = anchors["anchor_id"].to_numpy("i8"), anchors["label"].to_numpy("i8")
    scored = 0
    for b in np.argsort(-most.mean(axis=0), kind="stable"):
        floor = targets.floor()
        own = targets.anchor
        wanted = np.flatnonzero((most[own, b] >= floor) & (least[own, b] <= targets.most) & (floor <= targets.most))
        if not len(wanted):
            continue
        block = blocks.iloc[b]
        ids, labels = np.frombuffer(block.ids, "<i8"), np.frombuffer(block.labels, "<i8")
        rows = np.frombuffer(block.vectors, f"<i{block.width}").reshape(len(ids), block.dims)
        used, at = np.unique(own[wanted], return_inverse=True)
        scored += len(used)
        scores = products(vectors[used], rows)
        right = anchor_labels[used][:, None] == labels
        right = right & (anchor_ids[used][:, None] != ids) if targets.same_label else ~right
        scores = scores[at]
        fits = right[at] & (scores >= floor[wanted][:, None]) & (scores <= targets.most[wanted][:, None])
        t, j = np.nonzero(fits)
        if len(t):
            targets.add(wanted[t], scores[t, j], ids[j])
    return scored


def _vectors(packed: pd.Series) -> np.ndarray:
    rows = [np.frombuffer(p, "<i8") for p in packed]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), "i8")
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _found(anchors: pd.DataFrame, targets: Targets, slots: np.ndarray) -> pd.DataFrame:
    t, k = np.nonzero(targets.scores != NO_SCORE)
    ids = pd.array(targets.ids[t, k], dtype="Int64")
    ids[targets.ids[t, k] == NO_ID] = pd.NA
    keys = anchors["anchor_key"].to_numpy("i8")[targets.anchor[t]]
    return pd.DataFrame({"anchor_key": keys, "slot": slots[t].astype("i4"), "id": ids, "score": targets.scores[t, k]})


def _slices(anchors: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for at in range(0, len(anchors), ANCHORS_AT_ONCE):
        part = anchors.iloc[at : at + ANCHORS_AT_ONCE].reset_index(drop=True)
        yield part, _vectors(part["vector"])


def _nearest(count: int):
    """The ``count`` highest scores within each anchor's label, of one cell of the grid."""

    def search(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})]
        for part, vectors in _slices(anchors if len(blocks) else anchors[:0]):
            n = len(part)
            targets = Targets(np.arange(n), np.full(n, NO_SCORE + 1), np.full(n, NO_ID - 1), count, True)
            scan(part, vectors, blocks, targets)
            out.append(_found(part, targets, np.zeros(n, "i4")))
        return pd.concat(out[1:] or out)

    return search


def _in_windows(count: int, low: int, high: int):
    """For each positive the ``count`` highest scores of other labels between ``low`` and
    ``high`` percent of the positive's, of one cell of the grid."""

    def search(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})]
        for part, vectors in _slices(anchors if len(blocks) else anchors[:0]):
            own = np.repeat(np.arange(len(part)), part["positives"].map(len))
            slots = np.concatenate([np.arange(len(p)) for p in part["positives"]])
            wanted = [p["score"] for row in part["positives"] for p in row]
            # Python's whole numbers, as 100 times a score may not fit in 64 bits.
            least = np.array([max(-((-low * int(p)) // 100), NO_SCORE + 1) for p in wanted], "i8")
            most = np.array([min((high * int(p)) // 100, NO_ID - 1) for p in wanted], "i8")
            targets = Targets(own, least, most, count, False)
            scan(part, vectors, blocks, targets)
            out.append(_found(part, targets, slots))
        return pd.concat(out[1:] or out)

    return search


def _ranked(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first ``count`` of each group, equal (score, id) counted once."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= count).distinct()


def hard_negatives(
    rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``. Components become ``floor(scale * x)``, a score is
    the whole-number inner product; higher scores come first, equal ones by smaller id, null
    ids last. An anchor's positives are its ``positives`` first rows of the same label and
    another id. For each of them the ``negatives`` first rows of another label are returned
    whose score lies within ``low`` and ``high`` percent of the positive's.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    Vectors of different lengths are compared as if the shorter ended in zeros; empty and
    zero vectors score 0. A row that repeats (equal id and score for an anchor) counts once.
    Vectors longer than 2^31 after scaling fail, as their scores may not fit. Anchors
    without positives, and positives without negatives, have no row.
    """
    ship_package(rows.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    taken = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("vector"),
    ).where(
        "label IS NOT NULL AND vector IS NOT NULL AND "
        "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    )
    sample = taken.orderBy(F.xxhash64("id", "label", "vector")).limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    flat = np.concatenate([np.asarray(v, "f8") for v in sample]) if len(sample) else np.empty(0)
    references = farthest_first(quantized(flat, np.array([len(v) for v in sample], int), scale), REFERENCES)

    def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("dims", pa.int32()),
             ("angles_from", pa.list_(pa.float64())), ("angles_to", pa.list_(pa.float64())), ("norm_from", pa.float64()), ("norm_to", pa.float64())]
        )
        for frame in _make_blocks(batches, references, scale):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    def make_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = np.array([len(v) for v in frame["vector"]], int)
            flat = np.concatenate([np.asarray(v, "f8") for v in frame["vector"]]) if len(frame) else np.empty(0)
            vectors = quantized(flat, lengths, scale)
            yield pd.DataFrame({
                "anchor_key": frame["key"], "anchor_id": frame["id"], "label": frame["label"],
                "vector": [v.astype("<i8").tobytes() for v in vectors],
                "norm": np.linalg.norm(vectors.astype("f8"), axis=1), "angles": list(angles_to(references, vectors)),
            })

    blocks = materialize(taken.mapInArrow(make_blocks, _BLOCKS), "vector-blocks")
    asked = taken.where(is_anchor).distinct().withColumn("key", F.xxhash64("id", "label", "vector"))
    anchors = materialize(asked.mapInPandas(make_anchors, _ANCHORS), "anchors")
    n = blocks.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 8
    row_groups = max(min(ROW_GROUPS, 1 + n // 2048), -(-n // ROWS_PER_TASK))
    anchor_groups = 1 + anchors.count() // ANCHORS_PER_TASK
    grid = ["anchor_group", "row_group"]
    dealt = blocks.withColumn("row_group", F.pmod(F.xxhash64("ids", "vectors"), F.lit(row_groups))).withColumn(
        "anchor_group", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1)))
    ).groupBy(*[F.col(c).cast("int").alias(c) for c in grid])

    def met(searched: DataFrame, search) -> DataFrame:
        """What the search finds in every cell of the grid."""
        own = searched.withColumn("anchor_group", F.pmod("anchor_key", F.lit(anchor_groups))).withColumn(
            "row_group", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1)))
        )
        # Only the group columns differ in type between the two sides.
        own = own.groupBy(*[F.col(c).cast("int").alias(c) for c in grid])
        return dealt.cogroup(own).applyInPandas(lambda left, right: search(left, right), _FOUND)

    near = _ranked(met(anchors, _nearest(positives)), ["anchor_key"], positives)
    near = near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    searched = materialize(anchors.join(near, "anchor_key"), "positives")
    found = _ranked(met(searched, _in_windows(negatives, low, high)), ["anchor_key", "slot"], negatives)
    asked = searched.select("anchor_key", "anchor_id", F.posexplode("positives").alias("slot", "p"))
    return asked.join(found, ["anchor_key", "slot"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
