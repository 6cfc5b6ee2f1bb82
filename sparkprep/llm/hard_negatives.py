"""Hard negatives by slots of scores.

An anchor's positives are its best rows of the same label. Each positive allows
negatives (rows of other labels) whose score lies between a lower and an upper
percentage of its own. These windows overlap, but their upper limits split
the scores into disjoint slots: a slot reaches from one upper limit down to the next. The
first k of a window are found among the first k of its slot and of all slots below, so a row
is offered to one slot only, and k rows per slot are all that is kept.

Rows and anchors are packed into blocks; each pair of blocks is one matrix
product inside a task. A task keeps the best k per anchor and slot of what it has seen and
sends those at its end; a ranking window, which Spark also limits before the
shuffle, keeps k of them per slot. Last, the slots of an anchor (at most
positives x k rows) are read downwards from each positive's slot.

Anchor blocks are broadcast up to ``BROADCAST_BYTES`` in all, by their measured size; beyond
that, row blocks are dealt into groups and meet a copy of the anchor blocks in each.

Components become integers (``floor(scale * x)``, within 2**62) and scores are exact integers,
kept within 64 bits. Vectors of different lengths are compared over the shorter one.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part;
an empty vector scores 0; equal scores go by smaller id; rows of an anchor's id aren't its
positives; repeated anchors give one result; other repeated rows count each; long vectors shorten the
blocks; an empty table gives an empty result; other columns aren't read, so their names don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, q, small_batches

#: Rows (or anchors) and components of a block at most.
BLOCK_ROWS, BLOCK_COMPONENTS = 8192, 1 << 20
#: Rows and anchors that are multiplied at a time.
SLICE = 1024
#: Anchor blocks of this size together are broadcast.
BROADCAST_BYTES = 8 << 20
#: Blocks of which a task keeps results at a time; beyond that the oldest are sent.
OPEN_BLOCKS = 16
#: Offers are sorted into a block's results when there are this many.
PENDING = 1 << 17
SCALE = 256
LARGEST = np.iinfo(np.int64).max
WIDE = 1 << 62

#: A block: rows, width of the matrix, bytes per component, and the columns' bytes.
BLOCK = "n long, dims long, width long, ids binary, labels binary, vectors binary"
LIMITED = ", keys binary, uppers binary, lowers binary"
OFFER = "key long, upper long, score long, id long"


def _matrices(batch: pa.RecordBatch, scale: float):
    """(rows taking part, matrix of integers) for each power of two that the lengths of the vectors reach."""
    vectors = batch.column(2)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    good = np.ones(len(lengths), dtype=bool)
    for c in batch.columns:
        good &= c.is_valid().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.clip(np.floor(values * scale), -WIDE, WIDE)
    size = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for dims in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == dims))
        place = np.full(len(lengths), -1)
        place[rows] = np.arange(len(rows))
        at = place[row]
        out = np.zeros((len(rows), dims), dtype=np.int64)
        out[at[at >= 0], col[at >= 0]] = values[at >= 0].astype(np.int64)
        yield dims, rows, out


def _narrow(m: np.ndarray) -> np.ndarray:
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _pack(scale: float, limits: int):
    """Rows to blocks, one kind for each size of vector; ``limits`` more columns are packed beside."""
    fields = BLOCK + (LIMITED if limits else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def block(dims, parts):
        ids, labels, m, *more = (np.concatenate(p) for p in zip(*parts, strict=True))
        m = _narrow(m)
        values = [len(ids), dims, m.itemsize, *(x.tobytes() for x in (ids, labels, m, *more))]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for dims, rows, m in _matrices(batch, scale):
                most = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // dims))
                take = pa.array(rows)
                columns = [batch.column(k).take(take).to_numpy() for k in (0, 1)]
                if limits:
                    columns.append(batch.column(3).take(take).to_numpy())
                    for k, missing in ((4, -LARGEST), (5, LARGEST)):
                        out = np.full((len(rows), limits), missing, dtype=np.int64)
                        for j, x in enumerate(batch.column(k).take(take).to_pylist()):
                            out[j, :len(x)] = x
                        columns.append(out)
                ids, labels, *more = columns
                for s in range(0, len(rows), most):
                    part = [x[s:s + most] for x in (ids, labels, m, *more)]
                    parts = held.setdefault(dims, [])
                    if sum(len(p[0]) for p in parts) + len(part[0]) > most:
                        yield block(dims, held.pop(dims))
                        parts = held.setdefault(dims, [])
                    parts.append(part)
        for dims, parts in held.items():
            yield block(dims, parts)
    return run, fields


def _product(a: np.ndarray, b: np.ndarray):
    """Both blocks in the narrowest type in which all scores are exact (Python integers, if none is)."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = d * max(1, abs(int(a.min(initial=0))), int(a.max(initial=0))) * max(1, abs(int(b.min(initial=0))), int(b.max(initial=0)))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    return a.astype(kind), b.astype(kind)


class Best:
    """The first k rows per anchor and slot of one anchor block."""

    def __init__(self, block: dict, limits: int, k: int, same: bool):
        self.ids, self.labels = (np.frombuffer(block[c], dtype=np.int64) for c in ("ids", "labels"))
        self.keys = np.frombuffer(block["keys"], dtype=np.int64)
        self.uppers, lowers = (np.frombuffer(block[c], dtype=np.int64).reshape(-1, limits) for c in ("uppers", "lowers"))
        self.matrix = _matrix(block)
        self.least = lowers.copy()
        self.k, self.same = k, same
        self.kept = [np.zeros(0, dtype=np.int64)] * 4
        self.pending, self.waiting = [], 0

    def offer(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        mine, theirs = _product(self.matrix, matrix)
        for r in range(0, len(ids), SLICE):
            rows = slice(r, r + SLICE)
            for a in range(0, len(self.ids), SLICE):
                self._slice(mine[a:a + SLICE] @ theirs[rows].T, slice(a, a + SLICE), ids[rows], labels[rows])

    def _slice(self, scores, part, ids, labels):
        if scores.dtype == object:
            scores = np.clip(scores, -LARGEST, LARGEST).astype(np.int64)
        match = self.labels[part][:, None] == labels[None, :]
        match = match if self.same else ~match
        # least may be rounded here; the exact comparison follows on what is left
        match &= scores >= self.least[part].min(axis=1).astype(scores.dtype)[:, None]
        match &= scores <= self.uppers[part].max(axis=1).astype(scores.dtype)[:, None]
        anchor, row = np.nonzero(match)
        score, anchor, found = scores[anchor, row].astype(np.int64), anchor + part.start, ids[row]
        slot = (score[:, None] <= self.uppers[anchor]).sum(axis=1) - 1
        good = (slot >= 0) & (score >= self.least[anchor, slot])
        if self.same:
            good &= found != self.ids[anchor]
        self.pending.append([x[good] for x in (anchor, slot, score, found)])
        self.waiting += int(good.sum())
        if self.waiting >= PENDING:
            self.settle()

    def settle(self) -> None:
        anchor, slot, score, found = (np.concatenate(x) for x in zip(self.kept, *self.pending, strict=True))
        order = np.lexsort((found, -score, slot, anchor))
        anchor, slot, score, found = (x[order] for x in (anchor, slot, score, found))
        first = np.ones(len(anchor), dtype=bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
        starts = np.flatnonzero(first)
        rank = np.arange(len(anchor)) - starts[np.cumsum(first) - 1] if len(anchor) else starts
        last = rank == self.k - 1
        self.least[anchor[last], slot[last]] = score[last]
        self.kept = [x[rank < self.k] for x in (anchor, slot, score, found)]
        self.pending, self.waiting = [], 0

    def offers(self) -> pa.RecordBatch:
        self.settle()
        anchor, slot, score, found = self.kept
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.keys[anchor], self.uppers[anchor, slot], score, found)],
                                          [f.split()[0] for f in OFFER.split(", ")])


def _matrix(block: dict) -> np.ndarray:
    return np.frombuffer(block["vectors"], dtype=f"i{block['width']}").reshape(block["n"], block["dims"])


def _select(limits: int, k: int, same: bool):
    def run(batches):
        open_: dict[int, Best] = {}
        for batch in batches:
            for pair in range(batch.num_rows):
                row, anchors, key = (batch.column(c)[pair].as_py() for c in ("rows", "anchors", "block"))
                if key not in open_:
                    if len(open_) >= OPEN_BLOCKS:
                        yield open_.pop(next(iter(open_))).offers()
                    open_[key] = Best(anchors, limits, k, same)
                ids, labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
                open_[key].offer(ids, labels, _matrix(row))
        for best in open_.values():
            yield best.offers()
    return run


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group by score and id, as ``rank``."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(rows: DataFrame, anchors: DataFrame, limits: int, k: int, same: bool, scale: float = SCALE,
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key, upper, score, id, rank``: of each anchor and slot the first k ``rows(id, label, vector)`` of the same label, or of others.

    ``anchors(id, label, vector, key, uppers, lowers)`` name their slots by ``uppers``, descending, at most
    ``limits``; a slot holds scores of its lower limit or more, above the next upper limit.
    """
    spark = rows.sparkSession
    small_batches(spark)
    pack, shape = _pack(scale, 0)
    packed = rows.select("id", "label", "vector").mapInArrow(pack, shape)
    pack, shape = _pack(scale, limits)
    n = anchors.count()
    held = anchors.select("id", "label", "vector", "key", "uppers", "lowers").repartition(max(1, -(-n // BLOCK_ROWS)))
    held = cut(held.mapInArrow(pack, shape).select(F.monotonically_increasing_id().alias("block"), F.struct("*").alias("anchors")))
    total = held.agg(F.sum(sum(F.length(f"anchors.{c}") for c in ("ids", "labels", "vectors", "keys", "uppers", "lowers")))).first()[0] or 0
    if total <= broadcast_bytes:
        groups, held = 1, F.broadcast(held.withColumn("group", F.lit(0)))
    else:
        groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
        held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = packed.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"), F.struct("*").alias("rows"))
    offers = dealt.join(held, "group").select("rows", "anchors", "block").mapInArrow(_select(limits, k, same), OFFER)
    return _first(offers, ["key", "upper"], k)


def _percent(score: str, percent: int, up: bool) -> Column:
    """``percent`` of a score, rounded up or down, within 64 bits."""
    part = F.col(score).cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    whole = (F.ceil if up else F.floor)(part)
    return F.greatest(F.least(whole, F.lit(int(LARGEST))), F.lit(-int(LARGEST))).cast("long")


def mine(table: DataFrame, anchor: Column, id_col: str = "vec_id", label: Column | None = None, vector: str = "embedding",
         positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = SCALE,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors. A negative's score lies between ``least`` and ``most`` percent of the positive's.
    """
    rows = table.select(q(id_col).cast("long").alias("id"), (q("label") if label is None else label).cast("long").alias("label"),
                        q(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    anchors = cut(rows.where("is_anchor").select("id", "label", "vector").distinct().withColumn("key", F.monotonically_increasing_id()))
    every = F.array(F.lit(int(LARGEST)))
    first = best_rows(rows, anchors.withColumns({"uppers": every, "lowers": F.array(F.lit(-int(LARGEST)))}), 1, positives, True, scale, broadcast_bytes)
    found = cut(first.select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                             _percent("score", most, False).alias("upper"), _percent("score", least, True).alias("lower")))
    # a slot's own lower limit is the least that any window reaching into it allows
    slots = found.where("lower <= upper").groupBy("key", "upper").agg(F.min("lower").alias("lower")).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("upper", "lower")), asc=False).alias("slots"))
    lowest = F.transform("slots", lambda s, i: F.array_min(F.slice("slots", F.lit(1), i + 1)["lower"]))
    limited = anchors.join(slots.select("key", F.col("slots.upper").alias("uppers"), lowest.alias("lowers")), "key")
    kept = best_rows(rows, limited, positives, negatives, False, scale, broadcast_bytes)
    down = kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", F.col("upper").alias("slot")))).alias("slots"))
    windows = found.join(down, "key")
    below = F.slice(F.filter("slots", lambda s: s["slot"] <= F.col("upper")), 1, negatives)
    answers = windows.select("key", "positive_id", "positive_score",
                             F.posexplode(F.filter(below, lambda s: -s["down"] >= F.col("lower"))).alias("place", "hit"))
    return answers.join(anchors.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("negative_id"),
        "positive_score", (-F.col("hit.down")).alias("negative_score"))
