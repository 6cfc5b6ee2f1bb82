"""Mix sources to target weights by hierarchical budgets.

The leaves of the tree are the distinct values of the levels (domain, language,
source). A leaf offers at most ``epochs`` times its tokens. The budget flows
from the root: at each node it is shared among the children by weight; a child
that can't take its share leaves the rest to its siblings, and only what the
whole subtree can't take reaches the siblings of the parent, since a node
never gets more than its subtree offers. Each leaf then takes the longest token prefix
of its epochs, in which the documents stand in a seeded order that differs from
epoch to epoch.

Native expressions only. Documents are never gathered per leaf: prefixes are
found over hash ranges, and only the documents of the one range in which a
leaf's budget ends are ordered.

Defined cases: a null or empty text has no tokens and is never selected; null
levels are a value of their own; a weight of zero takes nothing; repeated rows
(same id and text in one leaf) count each and are taken all or none; rows of
equal order go by id and text hash; a long text's words are counted by one task; an empty table gives an empty result;
columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, q

SEED = 7
EPOCHS = 2
#: The budget, as a share of the tokens that the input has.
SHARE = 0.5
#: Hash digits (hex) per refinement, and the number of refinements.
DIGITS = 3
STEPS = 2


def domain_of(source: Column) -> Column:
    """Domain of a source: its number modulo 4; others and null fall into domain ``d``."""
    return F.concat(F.lit("d"), F.coalesce(
        (F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1).try_cast("long") % 4).cast("string"), F.lit("")))


#: Target weights of the levels; values that aren't named weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2}, "source": {}}


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(value)), float(w)).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent columns, ``budget`` of the parent, ``cap``, ``w``) with ``got``.

    Water filling: the level rises until it no longer lifts a child over its cap.
    Each round sums per parent (combined before the shuffle) and settles the
    children that the level fills; it ends when a round settles none.
    """
    key = parent or ["_root"]
    c = children if parent else children.withColumn("_root", F.lit(0))
    c = c.withColumn("full", (F.col("cap") <= 0) | (F.col("w") <= 0))
    c = c.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    settled = -1
    while True:
        level = c.groupBy(*[F.col(k).alias("_p_" + k) for k in key]).agg(
            (F.max("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0))).alias("_left"),
            F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("_open"))
        same = [F.col(k).eqNullSafe(F.col("_p_" + k)) for k in key]
        on = same[0]
        for s in same[1:]:
            on = on & s
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("_left") / F.col("_open"))
        c = c.join(level, on).withColumn("got", share).drop("_left", "_open", *["_p_" + k for k in key])
        c = cut(c.withColumn("full", F.col("full") | (F.col("got") >= F.col("cap"))))
        now = c.where("full").count()
        if now == settled:
            return c.withColumn("got", F.least("got", "cap")).drop("full", "_root")
        settled = now


def budgets(leaves: DataFrame, levels: list[str], budget: float, epochs: int,
            weights: dict[str, dict[str, float]]) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``got``, the whole tokens allotted to each."""
    held = leaves.select(*levels, "tokens", F.lit(float(budget)).alias("budget"))
    for i, level in enumerate(levels):
        path = levels[:i + 1]
        node = held.groupBy(*path).agg((F.sum("tokens") * F.lit(float(epochs))).alias("cap"), F.max("budget").alias("budget"))
        top = levels[:i]
        whole = node.groupBy(*[F.col(t).alias("_t_" + t) for t in top]).agg(F.sum("cap").alias("_cap"))
        on = F.lit(True)
        for t in top:
            on = on & F.col(t).eqNullSafe(F.col("_t_" + t))
        node = node.join(whole if top else F.broadcast(whole), on).withColumn("budget", F.least("budget", "_cap"))
        node = node.drop("_cap", *["_t_" + t for t in top]).withColumn("w", weight_of(level, weights))
        got = share_out(node, top).select(*[F.col(p).alias("_g_" + p) for p in path], "got")
        on = F.lit(True)
        for p in path:
            on = on & F.col(p).eqNullSafe(F.col("_g_" + p))
        held = held.drop("budget").join(got.withColumnRenamed("got", "budget"), on).drop(*["_g_" + p for p in path])
    return held.select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("got"))


def seeded(epoch: Column, id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(q(id_col).cast("string"), F.lit("null"))))


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(left, right, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def choose(docs: DataFrame, id_col: str = "doc_id", text: str = "text", levels: dict[str, Column] | None = None,
           share: float = SHARE, epochs: int = EPOCHS, weights: dict[str, dict[str, float]] | None = None,
           seed: int = SEED) -> DataFrame:
    """What is selected, without texts: the levels, ``_id``, ``_sig`` (hash of the text),
    ``_copies`` (repeated rows, taken all or none), ``n_tokens`` of one copy, ``epoch``."""
    levels = levels or {"domain": domain_of(q("source")), "lang": q("lang"), "source": q("source")}
    names = list(levels)
    there = ["_l_" + n for n in names]
    slim = cut(docs.select(*[c.alias(n) for n, c in levels.items()], n_words(q(text)).alias("n_tokens"),
                           q(id_col).alias("_id"), F.xxhash64(q(text)).alias("_sig")).where("n_tokens > 0")
               .groupBy(*names, "_id", "_sig").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("_copies"))
               .withColumn("_size", F.col("n_tokens") * F.col("_copies")))
    leaves = cut(slim.groupBy(*names).agg(F.sum("_size").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, names, total * share, epochs, WEIGHTS if weights is None else weights)
    # whole epochs are taken whole; the last one is cut
    plan = plan.withColumn("_whole", F.floor(F.col("got") / F.col("tokens")).cast("int"))
    plan = cut(plan.select(*[F.col(n).alias(t) for n, t in zip(names, there, strict=True)], "_whole",
                           (F.col("got") - F.col("_whole") * F.col("tokens")).alias("_rest")))
    rows = slim.join(plan, _same(names, there)).drop(*there)
    last = _prefix(rows.where("_rest > 0").withColumn("_key", seeded(F.col("_whole") + 1, "_id", seed)), names)
    kept = [*names, "_id", "_sig", "_copies", "n_tokens"]
    whole = rows.where("_whole > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("_whole"))).alias("epoch"))
    return whole.unionByName(last.select(*kept, (F.col("_whole") + 1).alias("epoch")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", levels: dict[str, Column] | None = None,
                **how) -> DataFrame:
    """The selected documents: their columns, the levels that aren't among them,
    ``n_tokens`` and ``epoch`` (1 ...). A document taken in several epochs comes once for each."""
    levels = levels or {"domain": domain_of(q("source")), "lang": q("lang"), "source": q("source")}
    names = list(levels)
    picked = choose(docs, id_col, text, levels, **how).select(
        F.struct(*names).alias("leaf"), F.col("_id").alias("of"), F.col("_sig").alias("of_sig"), "n_tokens", "epoch")
    rows = docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"), q(id_col).alias("id"), F.xxhash64(q(text)).alias("sig"),
                       F.struct(*[c.alias(n) for n, c in levels.items()]).alias("mine"))
    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig")) & F.col("mine").eqNullSafe(F.col("leaf"))
    old = [c for c in docs.columns if c.lower() not in ("n_tokens", "epoch")]
    new = [n for n in names if n.lower() not in {c.lower() for c in old}]
    return rows.join(picked, on).select(*[F.col("row")[c].alias(c) for c in old], *[F.col("mine")[n].alias(n) for n in new], "n_tokens", "epoch")


def _prefix(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of each leaf the rows, in order of (_key, _id, _sig), whose running tokens stay within ``_rest``.

    Rows are narrowed by leading hash digits: tokens per digit group are summed, the group
    in which the budget ends is found per leaf, groups before it are taken,
    and only that group goes on to the next refinement.
    """
    open_, taken = rows, None
    for step in range(STEPS):
        digits = F.substring("_key", 1 + step * DIGITS, DIGITS)
        grouped = open_.withColumn("_g", digits)
        sums = grouped.groupBy(*names, "_g").agg(F.sum("_size").alias("_sum"))
        before = F.sum("_sum").over(W.partitionBy(*names).orderBy("_g").rowsBetween(W.unboundedPreceding, -1))
        sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).select(
            *[F.col(n).alias("_l_" + n) for n in names], F.col("_g").alias("_lg"), "_sum", "_before")
        on = F.col("_g") == F.col("_lg")
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col("_l_" + n))
        placed = cut(grouped.join(sums, on).drop("_lg", "_g", *["_l_" + n for n in names]))
        whole = placed.where("_before + _sum <= _rest").drop("_before", "_sum")
        taken = whole if taken is None else taken.unionByName(whole)
        open_ = placed.where("_before <= _rest AND _before + _sum > _rest").withColumn(
            "_rest", F.col("_rest") - F.col("_before")).drop("_before", "_sum")
    run = F.sum("_size").over(W.partitionBy(*names).orderBy("_key", "_id", "_sig").rowsBetween(W.unboundedPreceding, 0))
    return taken.unionByName(open_.withColumn("_run", run).where("_run <= _rest").drop("_run"))

