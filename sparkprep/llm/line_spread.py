"""Cross-site boilerplate lines.

Every line is known by two 64-bit hashes. HyperLogLog sketches of the sites per
line merge by aggregation, without rows for pairs of line and site; only lines whose
estimate lies near the threshold get such rows, and an exact distinct count. A line found on ``min_sites`` sites or more is removed
everywhere but at its first place (smallest id, then position), so that no text
leaves the corpus altogether.

Defined cases: a null text has no lines and stays null; lines without a word
are never boilerplate; a null site counts as no site; repeated rows (same id
and text) are one document and get the same result; a long text is as many rows as it has lines; a line on just as many
sites as the limit is boilerplate; columns of any name are kept as they are; an empty table gives an
empty result. A document left without any line becomes the empty string.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, q, small, wrapped

MIN_SITES = 10
#: log2 of the registers; estimates of small sets are exact.
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: over ten
#: standard errors of the sketch.
NEAR = 0.2
#: Up to this many line hashes are broadcast: about 30 MB.
BROADCAST_LINES = 500_000


def lines(docs: DataFrame, id_col: str, text: str, site: str) -> DataFrame:
    """``(id, sig, site, pos, h1, h2)`` of each line with a word."""
    at = docs.select(q(id_col).alias("id"), F.xxhash64(q(text)).alias("sig"), q(site).cast("string").alias("site"),
                     F.posexplode(F.split(q(text), "\n")).alias("pos", "line"))
    return at.where(F.col("line").rlike(f"[^{SPACE}]")).select(
        "id", "sig", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def spread(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """``(h1, h2, first)`` of the lines on ``min_sites`` sites or more; ``first`` is (id, sig, pos)."""
    place = F.struct("id", "sig", "pos")
    # lines that occur fewer than min_sites times can't be on that many sites
    often = small(cut(found.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")), BROADCAST_LINES)
    est = cut(found.join(often, ["h1", "h2"]).groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min(place).alias("first")))
    sure = est.where(F.col("sites") >= min_sites * (1 + near)).select("h1", "h2", "first")
    close = small(est.where((F.col("sites") >= min_sites * (1 - near)) & (F.col("sites") < min_sites * (1 + near))).drop("sites"), BROADCAST_LINES)
    exact = found.join(close.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(close.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES) -> DataFrame:
    """``(id, sig, gone)``: the positions of the lines to remove, for documents with any."""
    found = lines(docs, id_col, text, site)
    common = small(cut(spread(found, min_sites)), BROADCAST_LINES)
    hit = found.join(common, ["h1", "h2"]).where(~F.struct("id", "sig", "pos").eqNullSafe(F.col("first")))
    return hit.groupBy("id", "sig").agg(F.collect_set("pos").alias("gone"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source",
                       min_sites: int = MIN_SITES, removed: str | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; ``removed`` names an
    extra column for the number of removed lines."""
    gone = boilerplate(docs, id_col, text, site, min_sites).select(F.col("id").alias("of"), F.col("sig").alias("of_sig"), "gone")
    joined = wrapped(docs, id_col, text).join(
        gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig")), "left")
    own = F.col("row")[text]
    joined = joined.select("row", "gone", F.when(F.col("gone").isNotNull(), F.split(own, "\n")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    new = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    cols = [(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns]
    return joined.select(*cols, *([F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(removed)] if removed else []))
