"""Stupid-backoff scores of documents against the corpus.

A token's score is the relative frequency of its n-gram after its history if the
n-gram occurs ``min_count`` times or more, else ``ALPHA`` times the score under the
history shortened by one word; a single word scores its share of all tokens.
A document's score is the mean logarithm over its tokens.

The n-gram counts form one table over all orders, partitioned by ranges of the
n-gram hash. The documents are dealt into blocks; a block sends each of its distinct n-grams
with its count to the partition (many n-grams to a row, as packed numbers),
where the counts of all blocks are added up and joined back to the n-grams that
asked; the counts return to the block, where scores are summed per document. So a
frequent n-gram is one number for each block, and no row or group grows with its frequency.

Defined cases: words are runs of bytes other than ASCII white space, with A-Z
lower-cased; a null or empty text has no tokens and a null score; repeated rows count each,
and are scored row by row; a long text makes a block of its own, which one task holds; a count equal to the least one
isn't backed off; other columns aren't read; an empty table gives an empty result. N-grams are known by
64-bit hashes and don't cross documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, q, small_batches
from .textbytes import NON_SPACE, gram_hashes, word_hashes

ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of text in a block of documents.
BLOCK_BYTES = 8 << 20
#: Counts from here on don't fit the byte that most counts travel in, and come apart.
LARGE = 255


class Grams:
    """Distinct n-grams of a block, and for each order the place of every token's n-gram among them (-1: none)."""

    def __init__(self, texts: list[str | None], order: int):
        words, self.first = word_hashes(texts, NON_SPACE)
        total = len(words)
        self.history = np.arange(total) - np.repeat(self.first[:-1], np.diff(self.first))
        ends = [np.flatnonzero(self.history >= k - 1) for k in range(1, order + 1)]
        every = [gram_hashes(words, k)[e - k + 1] for k, e in enumerate(ends, 1)]
        self.hash, places, self.n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        self.at = np.full((order, total), -1, dtype=np.int64)
        done = 0
        for k, e in enumerate(ends):
            self.at[k, e] = places[done:done + len(e)]
            done += len(e)

    def edges(self, buckets: int) -> np.ndarray:
        """Where the n-grams of each hash range begin; ranges are equally wide."""
        limits = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
        return np.concatenate(([0], np.searchsorted(self.hash, limits), [len(self.hash)]))

    def scores(self, counts: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: sum of logarithms without the tokens' total, tokens scored as single words, tokens that backed off."""
        order, total = self.at.shape
        value, used = np.zeros(total), np.zeros(total, dtype=np.int64)
        longest = np.minimum(self.history + 1, order)
        for k in range(order, 0, -1):
            mine = np.flatnonzero((used == 0) & (longest >= k))
            c = counts[self.at[k - 1, mine]]
            if k > 1:
                good = c >= min_count
                mine, c = mine[good], c[good]
                value[mine] = np.log(c) - np.log(counts[self.at[k - 2, mine - 1]])
            else:
                value[mine] = np.log(c)
            used[mine] = k
        value += np.log(ALPHA) * (longest - used)
        add = lambda x: np.concatenate(([0], np.cumsum(x)))[self.first[1:]] - np.concatenate(([0], np.cumsum(x)))[self.first[:-1]]
        return add(value), add(used == 1), add(used < longest)


def _ask(order: int, buckets: int):
    def run(key, table):
        g = Grams(table.column("text").to_pylist(), order)
        edges, n = g.edges(buckets), g.n.astype(np.uint32)
        some = np.flatnonzero(np.diff(edges))
        return pa.table({
            "bucket": pa.array(some.astype(np.int64)), "block": pa.array(np.full(len(some), key[0].as_py(), dtype=np.int64)),
            "grams": pa.array([g.hash[edges[b]:edges[b + 1]].tobytes() for b in some], pa.binary()),
            "n": pa.array([n[edges[b]:edges[b + 1]].tobytes() for b in some], pa.binary())})
    return run


def _count(key, table):
    """Adds up a range of the count table and joins it to the n-grams that asked."""
    asked = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
    n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("n").to_pylist()])
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)[place]
    parts = np.split(counts, np.cumsum([len(a) for a in asked])[:-1])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "small": pa.array([np.minimum(p, LARGE).astype(np.uint8).tobytes() for p in parts], pa.binary()),
                     "large": pa.array([p[p >= LARGE].tobytes() for p in parts], pa.binary())})


def _score(order: int, min_count: int):
    def run(docs, counted):
        g = Grams(docs.column("text").to_pylist(), order)
        by = np.argsort(counted.column("bucket").to_numpy())
        small, large = (counted.column(c).to_pylist() for c in ("small", "large"))
        counts = np.frombuffer(b"".join(small[i] for i in by), dtype=np.uint8).astype(np.int64)
        counts[counts == LARGE] = np.frombuffer(b"".join(large[i] for i in by), dtype=np.int64)
        total, single, backed = g.scores(counts, min_count)
        return pa.table({"row": docs.column("row"), "n_tokens": pa.array(np.diff(g.first).astype(np.int64)), "logs": pa.array(total),
                         "n_single": pa.array(single.astype(np.int64)), "n_backoff": pa.array(backed.astype(np.int64))})
    return run


def score(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None, order: int = ORDER,
          min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep`` (new name -> name), ``n_tokens``,
    ``n_backoff`` (tokens scored under a shortened history) and ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep or {"doc_id": "doc_id"}
    total = docs.agg(F.sum(F.octet_length(q(text)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BLOCK_BYTES) + 1)
    row = F.struct(*[q(o).alias(n) for n, o in keep.items()])
    # as many partitions as blocks, whatever the session's setting: a task holds one block or so
    dealt = docs.select(row.alias("row"), q(text).cast("string").alias("text"),
                        F.pmod(F.xxhash64(*[q(c) for c in keep.values()], q(text)), F.lit(parts)).alias("block")).repartition(parts, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(order, parts), "bucket long, block long, grams binary, n binary")
    counted = asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(
        _count, "block long, bucket long, small binary, large binary").repartition(parts, "block")
    shape = dealt.schema["row"].dataType.simpleString()
    scored = cut(dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        _score(order, min_count), f"row {shape}, n_tokens long, logs double, n_single long, n_backoff long"))
    whole = free_name("corpus_tokens", keep)
    tokens = scored.agg(F.sum("n_tokens").alias(whole))  # one row
    mean = F.when(F.col("n_tokens") > 0, (F.col("logs") - F.col("n_single") * F.log(F.col(whole))) / F.col("n_tokens"))
    return scored.join(F.broadcast(tokens)).select(*[F.col("row")[n].alias(n) for n in keep], "n_tokens", "n_backoff", mean.alias("score"))
