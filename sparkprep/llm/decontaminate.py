"""Benchmark decontamination as a prefix-filtered set join.

The items are cut into windows (``size`` consecutive words; a shorter item is
one window). A window is the set of its word shingles, with their places; a document
contains it only if it contains all of them, so the prefix that has to be
joined is one shingle: the rarest one over all documents. Documents send only the
places of such shingles (with the words around them) to the join; a fixed-size
bitmap of shingle hashes lets most others stay where they are. A candidate is kept if
the window fits at its place (enough words before and after) and if the words there
are the window's words.

Defined cases: a null or empty text, or an item, without words has none;
repeated items or windows count under each of their ids; repeated documents are
judged row by row; without items nothing is hit; a long text is read by one task, and where it repeats an item's
shingle, each place is a candidate of its own (some 26 bytes); only the columns of ``keep`` and the text are read, so
names don't clash; an empty table gives an empty result. Hits may overlap; a word counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, q, small_batches, wrapped
from .textbytes import ALNUM, Words, chunks

WINDOW = 13
SHINGLE = 5
#: A document is contaminated if at least this percentage of its words is hit.
PERCENT = 5
#: log2 of the bits in the bitmap of shingle hashes (4 MB, whatever the number of items).
BITS = 25


def _window_kernel(size: int, k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for at, _, held in chunks(texts):
                w = Words(held, ALNUM)
                grams = {j: w.grams(j).view(np.int64) for j in range(1, k + 1)}
                for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                    m = min(size, int(b - a))
                    j = min(k, m)
                    for s in range(a, b - m + 1) if m else ():
                        rows.append((ids[at + i], w.text(s, s + m), m, j, grams[j][s:s + m - j + 1].tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)],
                    ["item", "window", "m", "j", "shingles"])
    return run


def item_windows(items: DataFrame, id_col: str, text: str, size: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """``(window, m, j, shingles, items)``: distinct windows, their words, shingle
    length, shingle hashes by place, and the items (as strings) that hold them."""
    small_batches(items.sparkSession)
    rows = items.select(q(id_col).cast("string").alias("item"), q(text).cast("string").alias("text")).mapInArrow(
        _window_kernel(size, k), "item string, window string, m int, j int, shingles array<long>")
    return rows.groupBy("window", "m", "j").agg(F.any_value("shingles").alias("shingles"), F.collect_set("item").alias("items"))


def bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """Bitmap of the column ``h`` by its highest bits: at most 2 ** (bits - 3) bytes come to the driver."""
    top = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.groupBy(F.shiftright(top, 5).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 31 as int))")).alias("w"))
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    got = words.toPandas()
    out[got["at"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()


def _maybe(bits_of: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    top = h >> np.uint64(64 - bits)
    return (bits_of[(top >> np.uint64(5)).astype(np.int64)] >> (top & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0


def _doc_grams(w: Words, lengths: list[int], bits_of: np.ndarray, bits: int):
    """(j, place, hash) arrays of the shingles within one document that the bitmap may hold."""
    last = np.repeat(w.first[1:], np.diff(w.first))  # the end of each word's document
    for j in lengths:
        g = w.grams(j)
        at = np.flatnonzero(_maybe(bits_of, g, bits))
        at = at[at + j <= last[at]]
        yield j, at, g[at]


def _count_kernel(lengths: list[int], bits_of, bits: int):
    def run(batches):
        table = np.frombuffer(bits_of.value, dtype=np.uint32)
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for _, _, held in chunks(batch.column(0).to_pylist()):
                found += [h for _, _, h in _doc_grams(Words(held, ALNUM), lengths, table, bits)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
    return run


HIT = pa.struct([("h", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("words", pa.string())])


def _hit_kernel(lengths: list[int], size: int, bits_of, bits: int):
    def run(batches):
        table = np.frombuffer(bits_of.value, dtype=np.uint32)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = np.zeros(len(texts), dtype=np.int64)
            hits: list[list[dict]] = [[] for _ in texts]
            for at, upto, held in chunks(texts):
                w = Words(held, ALNUM)
                counts[at:upto] = w.count()
                of = np.repeat(np.arange(len(held)), np.diff(w.first))
                for j, places, hashes in _doc_grams(w, lengths, table, bits):
                    for p, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        d = int(of[p])
                        a, b = int(w.first[d]), int(w.first[d + 1])
                        lo, hi = max(a, p - size + j), min(b, p + size)
                        hits[at + d].append({"h": h, "at": p - a, "lo": p - lo, "words": w.text(lo, hi)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(hits, pa.list_(HIT))], ["row", "n_words", "hits"])
    return run


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             size: int = WINDOW, k: int = SHINGLE, bits: int = BITS, keep: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep`` (new name -> name), ``n_words``,
    ``n_hit``, ``items`` (ids as strings, sorted) and ``starts`` (word places of the windows found)."""
    spark = docs.sparkSession
    windows = cut(item_windows(items, item_id, item_text, size, k))
    lengths = sorted(r["j"] for r in windows.select("j").distinct().collect())  # at most k rows
    tokens = windows.select(F.explode("shingles").alias("h")).distinct()
    small_batches(spark)
    all_bits = spark.sparkContext.broadcast(bitmap(tokens, bits))
    seen = docs.select(q(text).cast("string").alias("text")).mapInArrow(
        _count_kernel(lengths, all_bits, bits), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # rarest shingle of each window: fewest places in the documents, then the hash
    by = windows.select("window", "m", "items", F.posexplode("shingles").alias("o", "h")).join(seen, "h", "left")
    prefix = by.groupBy("window", "m", "items").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("best"))
    prefix = prefix.where("best.n > 0").groupBy(F.col("best.h").alias("h")).agg(
        F.collect_list(F.struct(F.col("best.o").alias("o"), "m", "window", "items")).alias("windows"))
    prefix = cut(prefix)
    few_bits = spark.sparkContext.broadcast(bitmap(prefix.select("h"), bits))
    keep = keep or {}
    inner = F.struct(*[q(old).alias(new) for new, old in keep.items()], F.monotonically_increasing_id().alias("_row"))
    slim = docs.select(inner.alias("row"), q(text).cast("string").alias("text"))
    shape = slim.schema["row"].dataType.simpleString()
    found = slim.mapInArrow(_hit_kernel(lengths, size, few_bits, bits),
                            f"row {shape}, n_words long, hits array<struct<h:long,at:int,lo:int,words:string>>")
    one = found.select("row", "n_words", F.explode_outer("hits").alias("hit"))
    joined = one.join(prefix.withColumnRenamed("h", "ph"), F.col("hit.h") == F.col("ph"), "left")
    # the window starts o words before the shingle: it has to fit, and its words have to be there
    joined = joined.withColumn("around", F.split("hit.words", " "))
    fits = F.filter("windows", lambda x: (x["o"] <= F.col("hit.lo")) & (F.col("hit.lo") - x["o"] + x["m"] <= F.size("around")))
    true = F.filter(fits, lambda x: F.array_join(F.slice("around", F.col("hit.lo") - x["o"] + 1, x["m"]), " ") == x["window"])
    joined = joined.withColumn("true", true)
    places = F.transform("true", lambda x: F.struct((F.col("hit.at") - x["o"]).alias("start"), x["m"].alias("m")))
    grouped = joined.select("row", "n_words", places.alias("p"), F.flatten(F.transform("true", lambda x: x["items"])).alias("i")).groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("i")))).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("p", lambda x: F.sequence(x["start"], x["start"] + x["m"] - 1)))))
    return grouped.select(*[F.col("row")[new].alias(new) for new in keep], "n_words", hit.cast("long").alias("n_hit"),
                          "items", F.array_sort("p.start").alias("starts"))


def is_contaminated(percent: int = PERCENT):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Rows are matched by id and text hash."""
    slim = docs.select(q(id_col).alias("id"), q(text).alias("text"), F.xxhash64(q(text)).alias("sig"))
    bad = overlaps(slim, items, "text", keep={"bad_id": "id", "bad_sig": "sig"}, **how).where(is_contaminated()).select("bad_id", "bad_sig").distinct()
    rows = wrapped(docs, id_col, text)
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("sig") == F.col("bad_sig")), "left_anti").select("row.*")
