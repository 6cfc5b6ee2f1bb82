"""Removal of long byte strings that occur more than once, over sorted suffixes.

Texts are cut into tokens at content-defined places: the string of ``length``
bytes at each start has as its anchor the smallest 16-byte hash among its first ``SPREAD``
places (leftmost on ties), so that equal strings have equal anchors at equal places.
Only the suffixes at anchors are sorted, about one in ``SPREAD / 2`` places; each
stands for the run of starts that share it.

1. A suffix has two leading tokens: the hash of the bytes that every start of
   its run needs (from the anchor on), and the hash of all bytes that any of them needs.
   Suffixes are range-partitioned by them with sampled splitters (a frequent key is
   split, since ties go by document and place), each range is sorted by multikey
   quicksort, and neighbours are compared, also across range boundaries.
   A neighbour with both tokens equal makes the whole run repeated.
2. Where only the first token agrees (the edges of copies), the starts of the run are
   told apart: each is hashed over its ``length`` bytes (128 bits), and these are
   sorted and compared in the same way. Of equal runs one stands for all.

Strings are equal if 128 bits of their hashes are. Defined cases: a null or empty text
has no bytes; texts shorter than ``length`` are never touched; repeated rows
are copies of each other; a null id is a value of its own; texts longer
than ``SEGMENT`` are worked on in segments; an empty table gives an empty
result. What is left may not be UTF-8, so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, q, small_batches
from .textbytes import VALUES, Prefix, byte_values, chunks, encode, mix

LENGTH = 400
GRAM = 16
SPREAD = 128
SEGMENT = 1 << 20
VALUES_2 = byte_values(2)
NULL_ID = 9223372036854775807
#: Text bytes behind one range of suffixes.
RANGE_BYTES = 64 << 20
#: A run is one number: its first start, shifted, and its length (at most SPREAD).
SHIFT = 9


def multikey_order(keys: list[np.ndarray], small: int = 4096) -> np.ndarray:
    """Order of rows by several keys: three-way partition around a pivot of the first
    key, equal rows go on with the next key; short runs are sorted directly."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(keys[0])), 0)]
    while todo:
        rows, depth = todo.pop()
        if depth == len(keys) or len(rows) <= 1:
            out.append(rows)
        elif len(rows) <= small:
            out.append(rows[np.lexsort([k[rows] for k in reversed(keys[depth:])])])
        else:
            k = keys[depth][rows]
            pivot = np.sort(k[:: max(1, len(k) // 101)])[50 if len(k) > 101 else 0]
            todo += [(rows[k > pivot], depth), (rows[k == pivot], depth + 1), (rows[k < pivot], depth)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _segments(texts: list[bytes], length: int):
    """(text number, first byte, bytes, starts) with at most SEGMENT starts each."""
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), SEGMENT):
            part = t[at:at + SEGMENT + length - 1]
            yield i, at, part, len(part) - length + 1


def _runs(parts: list[bytes], starts: list[int], length: int):
    """For joined segments: per anchor the segment, first start in it, number of starts, and both tokens."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    prefix = Prefix(data)
    n = len(data) - GRAM + 1
    at = np.arange(n)
    value = (mix(prefix.raw(at, at + GRAM)) >> np.uint64(32)).astype(np.uint32)
    place = at.astype(np.int32)
    step = 1
    while step < SPREAD:
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.minimum(value[step:], value[:-step])
        step *= 2
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
    valid = np.concatenate([np.arange(f, f + s) for f, s in zip(first, starts, strict=True)])
    anchor = place[valid].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    lo, anchor = valid[new], anchor[new]
    many = np.diff(np.concatenate((new, [len(valid)])))
    core = mix(prefix.raw(anchor, anchor + (length - SPREAD)))
    with np.errstate(over="ignore"):
        shape = many.astype(np.uint64) * np.uint64(1 << 20) + (anchor - lo).astype(np.uint64)
        whole = mix(prefix.raw(lo, lo + many - 1 + length) + mix(shape))
    segment = np.searchsorted(first, lo, side="right") - 1
    return segment, lo - first[segment], many, core, whole


def _held(batches, limit: int, length: int):
    """Segments of several texts at a time: ids, hashes, and (number, first byte, bytes, starts)."""
    for batch in batches:
        ids, sigs, texts = (batch.column(c).to_pylist() for c in range(3))
        for a, b, held in chunks(texts, limit):
            group: list[tuple] = []
            size = 0
            for seg in _segments(held, length):
                group.append(seg)
                size += len(seg[2])
                if size >= limit:
                    yield ids[a:b], sigs[a:b], group
                    group, size = [], 0
            if group:
                yield ids[a:b], sigs[a:b], group


ROWS = "k1 long, k2 long, id long, sig long, run long"


def _rows(k1, k2, ids, sigs, run):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k1, k2, ids, sigs, run)],
                                      ["k1", "k2", "id", "sig", "run"])


def _anchor_kernel(length: int):
    def run(batches):
        for ids, sigs, group in _held(batches, 1 << 20, length):
            seg, lo, many, core, whole = _runs([g[2] for g in group], [g[3] for g in group], length)
            of, base = np.array([g[0] for g in group])[seg], np.array([g[1] for g in group])[seg]
            yield _rows(core, whole, np.array(ids, dtype=np.int64)[of], np.array(sigs, dtype=np.int64)[of],
                        ((base + lo) << SHIFT) | many)
    return run


def _edge_kernel(length: int):
    def run(batches):
        for batch in batches:
            for i, s, t, runs in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                b, r = encode(t), np.sort(np.array(runs, dtype=np.int64))
                lo, many = r >> SHIFT, r & ((1 << SHIFT) - 1)
                starts = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                for at in range(0, len(b), SEGMENT):
                    mine = starts[(starts >= at) & (starts < at + SEGMENT)]
                    if len(mine):
                        data = np.frombuffer(b[at:at + SEGMENT + length - 1], dtype=np.uint8)
                        one, two = (mix(Prefix(data, v).raw(mine - at, mine - at + length)) for v in (VALUES, VALUES_2))
                        yield _rows(one, two, np.full(len(mine), i), np.full(len(mine), s), (mine << SHIFT) | 1)
    return run


def _neighbour_kernel(once: bool):
    """Sorts a range and compares neighbours. Rows with an equal one (same), or with one that
    agrees in the first key only (near); the first and last row come as well, for the boundaries.
    once: rows that agree in everything count as one."""
    def run(batches):
        parts = [[np.asarray(b.column(c)) for c in range(5)] for b in batches if b.num_rows]
        if parts:
            yield from _compare([np.concatenate(c) for c in zip(*parts, strict=True)], once)
    return run


def _compare(cols: list[np.ndarray], once: bool):
    order = multikey_order(cols if once else cols[:2])
    cols = [c[order] for c in cols]
    if once:
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cols = [c[new] for c in cols]
    k1, k2 = cols[:2]
    one, both = k1[1:] == k1[:-1], k2[1:] == k2[:-1]
    same, near = np.zeros(len(k1), dtype=bool), np.zeros(len(k1), dtype=bool)
    for flag, hit in ((same, one & both), (near, one & ~both)):
        flag[1:] |= hit
        flag[:-1] |= hit
    edge = np.zeros(len(k1), dtype=bool)
    edge[[0, -1]] = True
    keep = np.flatnonzero(same | near | edge)
    part = TaskContext.get().partitionId()
    for at in range(0, len(keep), 1 << 16):
        rows = keep[at:at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c[rows]) for c in cols), pa.array(same[rows]), pa.array(near[rows]), pa.array(edge[rows]),
             pa.array(np.full(len(rows), part, dtype=np.int32))],
            ["k1", "k2", "id", "sig", "run", "same", "near", "edge", "part"])


def neighbours(rows: DataFrame, partitions: int, once: bool = False) -> DataFrame:
    """Per document ``(id, sig, same, near)``: its runs that have an equal one anywhere, and
    those beside one that agrees in the first key only."""
    ranged = rows.repartitionByRange(partitions, "k1", "k2", "id", "sig", "run")
    marked = ranged.mapInArrow(_neighbour_kernel(once), ROWS + ", same boolean, near boolean, edge boolean, part int")
    # two rows for each range: equal keys at the ends of different ranges are neighbours across their boundary
    first, both = W.partitionBy("k1"), W.partitionBy("k1", "k2")
    across = marked.where("edge").withColumn("near", F.min("k2").over(first) < F.max("k2").over(first)).withColumn(
        "same", F.min("part").over(both) < F.max("part").over(both))
    kept = ["id", "sig", "run", "same", "near"]
    flagged = marked.select(kept).unionByName(across.select(kept)).where("same OR near")
    pick = lambda c: F.collect_set(F.when(F.col(c), F.col("run"))).alias(c)
    return flagged.groupBy("id", "sig").agg(pick("same"), pick("near"))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut_kernel(length: int):
    def run(batches):
        for batch in batches:
            kept, spans, sizes, removed = [], [], [], []
            for t, *runs in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                b = encode(t)
                r = np.array([x for some in runs if some for x in some], dtype=np.int64)
                if not len(r):
                    kept.append(b), spans.append([]), sizes.append(len(b)), removed.append(0)
                    continue
                edges = np.zeros(len(b) + 1, dtype=np.int32)
                np.add.at(edges, r >> SHIFT, 1)
                np.add.at(edges, (r >> SHIFT) + (r & ((1 << SHIFT) - 1)) - 1 + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                turn = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
                spans.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
                kept.append(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes())
                sizes.append(len(b)), removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "n_removed", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH,
                   keep: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep`` (new name -> name), ``n_bytes``,
    ``n_removed``, ``spans`` (maximal removed runs of bytes) and ``kept`` (the bytes left)."""
    if length < SPREAD + GRAM:
        raise ValueError(f"length must be at least {SPREAD + GRAM}")
    spark = docs.sparkSession
    small_batches(spark)
    key = [F.coalesce(q(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(q(text)).alias("sig")]
    # one form of the documents for both joins, so that their texts are shuffled once
    named = docs.select(*key, F.struct(*[q(o).alias(n) for n, o in (keep or {id_col: id_col}).items()]).alias("row"), q(text).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length(q(text)))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // RANGE_BYTES) + 1)
    found = cut(neighbours(named.select("id", "sig", "text").mapInArrow(_anchor_kernel(length), ROWS), partitions))
    edges = found.where(F.size("near") > 0).select("id", "sig", "near")
    starts = named.join(edges, ["id", "sig"]).select("id", "sig", "text", "near", "row").mapInArrow(_edge_kernel(length), ROWS)
    more = neighbours(starts, partitions, once=True).select("id", "sig", F.col("same").alias("more"))
    both = named.join(found.select("id", "sig", "same"), ["id", "sig"], "left").join(more, ["id", "sig"], "left")
    shape = named.schema["row"].dataType.simpleString()
    out = both.select("row", "text", "same", "more").mapInArrow(
        _cut_kernel(length), f"row {shape}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select("row.*", "n_bytes", "n_removed", "spans", "kept")
