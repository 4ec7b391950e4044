"""Hard negatives by a full sort of every anchor's integer scores.

Tasks hold some megabytes of rows and score them against the anchors, which lie in
blocks in the shared folder. A first pass finds each anchor's positives; in the second
one a task sorts all its scores of an anchor, looks up the upper limit of every
positive by binary search, and reads on from there. Only the best few of each task are
shuffled and ranked again, so no anchor's scores come together in one place.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import Output, open_input
from .util import Tables, new_path, sized

#: A component x becomes floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
#: Bytes of vectors that a task scores at a time; anchors in a block of the shared folder; scores that are held at once.
ROW_BYTES = 32 << 20
BLOCK = 512
SCORES = 2 << 20


class Rows:
    """Rows in the order of their ids, equal ones once. `vectors` has integers, a row for each; shorter vectors end in zeros."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, vectors: np.ndarray, limits: list[list[int]] | None = None):
        order = np.lexsort((rows, ids))
        if len(order):
            i, r = ids[order], rows[order]
            order = order[np.concatenate(([True], (i[1:] != i[:-1]) | (r[1:] != r[:-1])))]
        self.ids, self.labels, self.rows, self.vectors = ids[order], labels[order], rows[order], vectors[order]
        self.limits = [limits[k] for k in order.tolist()] if limits is not None else None
        self.largest = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Rows:
        column = lambda name: np.concatenate([b[name].to_numpy() for b in batches])
        sizes = np.concatenate([b["vector"].value_lengths().to_numpy() for b in batches])
        flat = np.concatenate([b["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64) for b in batches])
        vectors = np.zeros((len(sizes), int(sizes.max(initial=0))))
        vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = np.floor(SCALE * flat)
        limits = [x for b in batches for x in b["limits"].to_pylist()] if "limits" in batches[0].schema.names else None
        return cls(column("vec_id"), column("label"), column("row"), vectors, limits)


def scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products, a row for each row of a: by doubles where sums stay below 2^53, else whole numbers of any size.

    `largest`: what the product of two components can't exceed.
    """
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if largest * max(d, 1) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a) @ whole(b).T


def best_positives(anchors: Rows, rows: Rows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, places in rows, scores) of the best rows of the anchor's label; anchors and rows of a label are scored together."""
    for label in np.unique(anchors.labels).tolist():
        own, other = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        if not len(other):
            continue
        ids, step = rows.ids[other], max(1, SCORES // len(other))
        for i in range(0, len(own), step):
            at = own[i : i + step]
            for a, s in zip(at.tolist(), scores(anchors.vectors[at], rows.vectors[other], anchors.largest * rows.largest)):
                order = np.argsort(-s, kind="stable")
                order = order[ids[order] != anchors.ids[a]][:POSITIVES]
                yield a, other[order], s[order]


def best_negatives(anchors: Rows, rows: Rows) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, positive's score, places in rows, scores): the first rows of other labels from the upper limit on, down to the lower one."""
    step = max(1, SCORES // max(1, len(rows.ids)))
    for i in range(0, len(anchors.ids), step):
        for a, s in enumerate(scores(anchors.vectors[i : i + step], rows.vectors, anchors.largest * rows.largest), i):
            order = np.argsort(-s, kind="stable")  # rows are in the order of ids, so ties are too
            order = order[rows.labels[order] != anchors.labels[a]]
            down = -s[order]
            for positive in anchors.limits[a]:
                begin = np.searchsorted(down, -(HIGH * positive // 100), "left")
                end = np.searchsorted(down, LOW * -positive // 100, "right")
                found = order[begin : min(begin + NEGATIVES, end)]
                if len(found):
                    yield a, positive, found, s[found]


def write_blocks(anchors: DataFrame, folder: str) -> list[str]:
    """Store anchors in blocks of bounded size; gives the names of those that committed tasks have written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                sink, path = io.BytesIO(), f"{folder}/{uuid4().hex}.arrow"
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(i, BLOCK))
                with Output(path) as file:
                    file.write(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return [row.path for row in anchors.mapInArrow(run, "path string").toLocalIterator()]


@lru_cache(maxsize=4)
def _block(path: str) -> Rows:
    with open_input(path) as f:
        return Rows.of(pa.ipc.open_stream(f.read()).read_all().to_batches())


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= ROW_BYTES:
            yield Rows.of(held)
            held, size = [], 0
    if held:
        yield Rows.of(held)


_POSITIVES = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long"
_NEGATIVES = "anchor_id long, anchor_row long, positive_score long, negative_id long, negative_row long, negative_score long"


def _search(rows: DataFrame, blocks: list[str], positives: bool) -> DataFrame:
    """The best rows of each task for the anchors of all blocks."""
    schema = _POSITIVES if positives else _NEGATIVES
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            for path in blocks:
                anchors, out = _block(path), []
                for a, *positive, at, s in best_positives(anchors, held) if positives else best_negatives(anchors, held):
                    known = [np.full(len(at), x, np.int64) for x in (anchors.ids[a], anchors.rows[a], *positive)]
                    out.append([*known, held.ids[at], held.rows[at], np.array(s, np.int64)])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return rows.mapInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): up to NEGATIVES for each positive of each anchor.

    `anchor` tells which rows are anchors; each of them has as positives the POSITIVES other rows of its label with the highest scores.
    Rows without an id or a label, or with a vector that is null or has a component that is null or not
    finite, take no part. Equal rows count once; different rows with the same id are rows of their own, but no positives of each
    other. Missing components of a shorter vector are 0. Ties go by id. A score must fit 64 bits. Other columns are not read.
    """
    spark = rows.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    good = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    kept = [F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.xxhash64(F.col(label).cast("long"), vector).alias("row")]
    every, folder, tables = good.select(kept), new_path(spark, "anchors"), Tables(spark)
    with Tables(spark) as own:
        anchors = own.write(good.where(anchor).select(kept).dropDuplicates(["vec_id", "row"]), "anchors")
        best = W.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
        found = _search(every, write_blocks(anchors, f"{folder}/all"), True).distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= POSITIVES)
        positives = tables.write(found, "positives")
        limits = positives.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_row").alias("row")).agg(F.collect_set("positive_score").alias("limits"))
        limited = own.write(anchors.join(sized(limits), ["vec_id", "row"]), "limited")
        near = own.write(_search(every, write_blocks(limited, f"{folder}/limited"), False).distinct(), "near")
        first = W.partitionBy("anchor_id", "anchor_row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
        negatives = tables.write(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES), "negatives")
    out = positives.join(sized(negatives), ["anchor_id", "anchor_row", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
