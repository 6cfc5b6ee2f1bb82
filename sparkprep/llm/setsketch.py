"""Near-duplicates by SetSketch registers.

A document is the set of its distinct word shingles (64-bit hashes). Its sketch
has ``registers`` registers: register i is the logarithm, cut to whole steps, of
the minimum over the set of an exponentially distributed hash with seed i. Sketches
merge by maximum and equal registers grow with similarity.

1. Documents with equal sets form a class, represented by its smallest row.
2. Bands of registers are hashed. In each band bucket the classes are compared
   with a centre (the class that shares most places in buckets), never all with
   all. Buckets whose other members are in one component are done. In the others, members
   outside of the centre's component are compared with the rest exactly, on packed
   sets, block by block inside tasks; only links become rows.
3. For a pair with a centre the similarity is estimated by maximum likelihood from all
   registers jointly; pairs far below the threshold (over six standard errors)
   are dropped, the others are verified on the full sets.
4. Components of the verified links.

At the threshold of 0.8 a pair misses all of the 40 bands of 5 registers
with a probability of about 3e-8.

Defined cases: a null or empty text, or one without words, has the empty set
and is linked with nothing; a text of fewer words than a shingle has one shingle, its
whole sequence; repeated rows are in one class and get the same result; a null
id counts as the largest one and its component is null only if all ids of it
are; a long text is sketched by one task and its set travels as one row of 8 bytes per shingle; a similarity equal to the
threshold links; other columns aren't read; an empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, q, small, small_batches, tidy_shuffles, wrapped
from .components import connected_components
from .textbytes import chunks, mix, shingle_sets

WORDS = 5
SIMILARITY = 80  # percent
BANDS = 40
ROWS = 5
#: Base of the register steps, rate of the exponentials, and the largest register (one byte).
STEP = 1.15
RATE = 20.0
TOP = 255
#: Pairs estimated lower than the threshold by more than this are dropped: 6.5 standard errors of 200 registers.
MARGIN = 0.2
LAST = 9223372036854775807
#: Bytes of packed sets in a block of members that are compared within a task.
BLOCK_BYTES = 2 << 20
#: Up to this many rows of an (id, hash) pair and a number are broadcast: about 40 MB.
BROADCAST_ROWS = 1_000_000


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Registers (one byte each) of non-empty sets; rows are sets."""
    out = np.empty((len(sets), count), dtype=np.uint8)
    if not sets:
        return out
    every = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    odd = mix(seeds) | np.uint64(1)
    for i in range(count):
        least = np.minimum.reduceat((every ^ seeds[i]) * odd[i], first)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1.0 - np.log(x) / np.log(STEP)), 0, TOP)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity from register rows and set sizes.

    With u and v the sets' shares of the sizes' sum, a register of the first is
    larger with probability p(u - v J), of the second with p(v - u J), where
    p(x) = -log_b(1 - x (b - 1) / b); the likelihood of the counts is concave
    in J, and its maximum is found by golden-section steps.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP), 1e-12, 1 - 1e-12)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) > likelihood(y)
        high, low = np.where(left, y, high), np.where(left, low, x)
    return (low + high) / 2


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that don't depend on the order of its members."""
    a, b = int(np.add.reduce(mix(s))), int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))))
    return tuple(int(x) for x in np.array([a, b], dtype=np.uint64).view(np.int64))


def _sketch_kernel(k: int, count: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            size = np.zeros(len(texts), dtype=np.int64)
            h = np.zeros((len(texts), 2), dtype=np.int64)
            regs: list[bytes | None] = [None] * len(texts)
            for at, _, held in chunks(texts, 1 << 19):
                sets = shingle_sets(held, k)
                some = [i for i, s in enumerate(sets) if len(s)]
                rows = registers([sets[i] for i in some], count)
                for i, row in zip(some, rows, strict=True):
                    size[at + i] = len(sets[i])
                    h[at + i] = _set_hash(sets[i])
                    regs[at + i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(regs, pa.binary())],
                ["id", "sig", "n_shingles", "h1", "h2", "regs"])
    return run


def sketch(docs: DataFrame, id_col: str, text: str, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, sig, n_shingles, h1, h2, regs)`` of each row; no texts."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(q(id_col).cast("long"), F.lit(LAST)).alias("id"),
                       F.xxhash64(q(text)).alias("sig"), q(text).cast("string").alias("text"))
    return slim.mapInArrow(_sketch_kernel(k, bands * rows),
                           "id long, sig long, n_shingles long, h1 long, h2 long, regs binary")


def _estimate_kernel(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            two = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for c in ("ra", "rb")]
            sizes = [np.asarray(batch.column(c), dtype=np.float64) for c in ("na", "nb")]
            keep = pa.array(estimate(*two, *sizes) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)
    return run


def _verify_kernel(k: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            both_texts = [t for two in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True) for t in two]
            sets: list[np.ndarray] = []
            for _, _, held in chunks(both_texts):
                sets += shingle_sets(held, k)
                while len(sets) > 1:
                    one, two, *sets = sets
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append(100 * both >= percent * (len(one) + len(two) - both))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _set_kernel(k: int):
    """Sorted shingle hashes of texts, packed."""
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for _, _, held in chunks(batch.column("t").to_pylist()) for s in shingle_sets(held, k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])
    return run


def _block_kernel(percent: int):
    """Links between the sets of two blocks. The shingles of one block are sorted once, with the
    sets that have them; a set of the other counts what it shares with each by looking up its shingles."""
    def run(batches):
        for batch in batches:
            for few, many in zip(batch.column("few").to_pylist(), batch.column("many").to_pylist(), strict=True):
                sets = [np.frombuffer(x["set"], dtype=np.uint64) for x in many]
                sizes = np.array([len(x) for x in sets])
                every = np.concatenate(sets)
                order = np.argsort(every, kind="stable")
                every, of = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
                links = []
                for x in few:
                    one = np.frombuffer(x["set"], dtype=np.uint64)
                    lo, hi = np.searchsorted(every, one), np.searchsorted(every, one, side="right")
                    n = hi - lo
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    both = np.bincount(of[at], minlength=len(sets))
                    found = np.flatnonzero(100 * both >= percent * (len(one) + sizes - both))
                    links += [(x["node"], many[i]["node"]) for i in found if many[i]["node"] != x["node"]]
                if links:
                    kind = batch.schema.field("few").type.value_type.field("node").type
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*links, strict=True)], ["u", "v"])
    return run


PAIR = "a struct<id:bigint,sig:bigint>, b struct<id:bigint,sig:bigint>"


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text: str, k: int,
             percent: int, margin: float = MARGIN) -> DataFrame:
    """The pairs ``(a, b)`` of classes whose full sets are similar enough."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("regs").alias("r" + x), F.col("n_shingles").alias("n" + x))
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
               .mapInArrow(_estimate_kernel(percent / 100 - margin), PAIR))
    texts = texts_of(docs, near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), id_col, text)
    of = lambda x: texts.select(F.col("node").alias(x), F.col("t").alias("t" + x))
    return near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_verify_kernel(k, percent), PAIR)


def unsettled(held: DataFrame) -> DataFrame:
    """The places of buckets whose members are in more than one component."""
    mixed = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return held.join(mixed, "bucket", "left_semi")


def texts_of(docs: DataFrame, nodes: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(node, t)``: the texts of the given nodes, one row each."""
    needed = small(cut(nodes.select("node").distinct()), BROADCAST_ROWS)
    return docs.select(F.struct(F.coalesce(q(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(q(text)).alias("sig")).alias("node"),
                       q(text).cast("string").alias("t")).join(needed, "node", "left_semi").dropDuplicates(["node"])


def blocks(members: DataFrame, name: str) -> DataFrame:
    """``members`` (family, node, set) as ``(family, <name>)``: lists of (node, set) of about BLOCK_BYTES each."""
    size = members.groupBy("family").agg(F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES).alias("parts"))
    dealt = members.join(small(cut(size), BROADCAST_ROWS), "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    return dealt.groupBy("family", "part").agg(F.collect_list(F.struct("node", "set")).alias(name)).drop("part")


def links_within(held: DataFrame, centres: DataFrame, docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """Every link ``(u, v)`` between members of one bucket of ``held`` (bucket, node, root) that are
    in different components.

    A family is all buckets whose centre is in one component: one of two such members
    is not in that component, so these are compared with all members of the family, block by
    block. Pairs are counted inside a task; only links become rows.
    """
    placed = cut(held.join(centres, "bucket").select("family", "node", "root").distinct())
    sets = cut(texts_of(docs, placed, id_col, text).mapInArrow(_set_kernel(k), "node struct<id:bigint,sig:bigint>, set binary"))
    members = placed.join(sets, "node").select("family", "node", "root", "set")
    few = blocks(members.where("root <> family").select("family", "node", "set"), "few")
    many = blocks(members.select("family", "node", "set"), "many")
    return few.join(many, "family").select("few", "many").mapInArrow(
        _block_kernel(percent), "u struct<id:bigint,sig:bigint>, v struct<id:bigint,sig:bigint>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS,
                    percent: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``sig`` (hash of the text), ``n_shingles``,
    and ``root_id``, ``root_sig``: the smallest row that it reaches."""
    with tidy_shuffles(docs.sparkSession):
        return _groups(docs, id_col, text, k, percent, bands, rows)


def _groups(docs: DataFrame, id_col: str, text: str, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    sketches = cut(sketch(docs, id_col, text, k, bands, rows))
    classes = cut(sketches.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(
        F.min(F.struct("id", "sig")).alias("node"), F.any_value("regs").alias("regs")))
    band = lambda i: F.xxhash64(i, F.substring("regs", i * rows + 1, rows))
    every = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(every.join(shared, "bucket").select("bucket", "node", "n"))
    degree = held.groupBy("node").agg(F.sum("n").alias("degree"))
    held = cut(held.drop("n").join(degree, "node").select("bucket", "node", "degree"))
    # the centre of a bucket is its member that shares most places
    best = F.min(F.struct((-F.col("degree")).alias("d"), "node"))["node"].alias("centre")
    chosen = cut(held.groupBy("bucket").agg(best))
    over = F.col("node") > F.col("centre")
    pairs = held.join(chosen, "bucket").where("node <> centre").select(
        F.when(over, F.col("centre")).otherwise(F.col("node")).alias("a"),
        F.when(over, F.col("node")).otherwise(F.col("centre")).alias("b")).distinct()
    links = cut(verified(cut(pairs), classes, docs, id_col, text, k, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
    component = cut(connected_components(links))
    # a bucket goes on if its members beside the centre are in several components
    left = held.join(chosen.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")
    left = cut(unsettled(left.join(component, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))))
    if not left.isEmpty():
        centres = chosen.join(component, F.col("centre") == F.col("node"), "left").select("bucket", F.coalesce("root", "centre").alias("family"))
        more = links_within(left, cut(centres), docs, id_col, text, k, percent)
        component = cut(connected_components(more.unionByName(component.select(F.col("node").alias("u"), F.col("root").alias("v")))))
    root = component.select(F.col("node").alias("_n"), "root")
    named = classes.select("h1", "h2", F.col("n_shingles").alias("n"), "node").join(root, F.col("node") == F.col("_n"), "left").select(
        "h1", "h2", "n", F.coalesce("root", "node").alias("root"))
    out = sketches.join(named, (sketches.h1 == named.h1) & (sketches.h2 == named.h2) & (sketches.n_shingles == named.n), "left")
    whole = F.coalesce(F.col("root"), F.struct("id", "sig"))
    ids = lambda c: F.when(c != LAST, c)
    return out.select(ids(F.col("id")).alias("id"), "sig", "n_shingles", ids(whole["id"]).alias("root_id"), whole["sig"].alias("root_sig"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with all their columns, of each group of near-duplicates only the one of
    the smallest id (of repeated rows, one). Documents without words all stay."""
    found = near_duplicates(docs, id_col, text, **how)
    kept = found.where((F.col("n_shingles") == 0) | (F.col("id").eqNullSafe(F.col("root_id")) & (F.col("sig") == F.col("root_sig"))))
    kept = kept.groupBy(F.col("id").alias("of"), F.col("sig").alias("of_sig")).agg(
        (F.count("*") == 1).alias("alone"), (F.max("n_shingles") == 0).alias("none"))
    joined = wrapped(docs, id_col, text).join(kept, F.col("id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig")))
    again = joined.where("NOT (alone OR none)").dropDuplicates(["of", "of_sig"])
    return joined.where("alone OR none").unionByName(again).select("row.*")
