"""Host-level quality rules.

Each document is measured once (native expressions only). Rule failures are
summed per host, every host's failure rate is shrunk towards the corpus with a
beta prior fitted by moments over the hosts, and the verdict of a host is
joined back to its documents.

Defined cases: a null text counts as empty and fails the length rule; a null or
empty host forms no host (its documents are judged alone); repeated rows are
measured and returned row by row; a long text is measured by one task, which holds an array of its words and their
windows; a rate equal to its limit doesn't fail; an empty table gives an empty result; other
columns never clash, as only the named ones are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, q, small, words, wrapped

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host is rejected if the shrunk rate of any rule is above this, or if that of documents
#: that fail some rule is above this share of the way from the corpus rate to 1.
HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
#: Up to this many host verdicts are broadcast: about 20 MB.
BROADCAST_HOSTS = 300_000
RULES = ("short", "repetitive", "symbols", "dup_lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _window(i: Column, size: int) -> Column:
    return F.slice("_w", i, size)


def measure(docs: DataFrame, text: str = "text", keep: dict[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """The columns of ``keep`` (new name -> name) and the counts of every whole text.

    Windows are compared by hash first; only texts in which a hash comes twice
    sort their windows as strings, so counts are exact.
    """
    t = F.coalesce(q(text), F.lit(""))
    df = docs.select(*[q(old).alias(new) for new, old in (keep or {}).items()], t.alias("_t"))
    df = df.withColumn("_w", words(F.col("_t")))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    n = F.size("_w")
    starts = F.sequence(F.lit(1), n - window + 1)
    df = df.withColumn("_h", F.when(n > window, F.transform(starts, lambda i: F.xxhash64(_window(i, window)))))
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform(
        starts, lambda i: F.struct(F.array_join(_window(i, window), " ").alias("g"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_s", j)["g"] == x["g"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    step = F.transform("_p", lambda x, j: F.least(F.lit(window), F.coalesce(F.get("_p", j + 1) - x, F.lit(window))))
    space = F.length(F.translate("_t", " \t\n\x0b\f\r", ""))
    return df.select(
        *(keep or {}),
        n.cast("long").alias("n_words"),
        space.cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def failures(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT,
             max_symbols: int = MAX_SYMBOL_PERCENT, max_dup_lines: int = MAX_DUP_LINE_PERCENT) -> dict[str, Column]:
    """Rule name -> whether a measured document fails it."""
    c = F.col
    return {
        "short": c("n_words") < min_words,
        "repetitive": c("n_repeat_words") * 100 > c("n_words") * max_repeat,
        "symbols": c("n_symbols") * 100 > c("word_chars") * max_symbols,
        "dup_lines": c("n_dup_lines") * 100 > c("n_lines") * max_dup_lines,
    }


def host_verdicts(measured: DataFrame, host: str = "host", rate: float = HOST_RATE,
                  rules: dict[str, Column] | None = None) -> DataFrame:
    """``host``, ``n_docs``, a shrunk ``rate_<rule>`` for each rule and ``rate_any`` for
    documents that fail at least one, and ``host_failed``.

    The counts combine before the shuffle, so a hot host is one row per task.
    Prior of a rule with failure share m: the spread of the hosts' rates beyond
    what their sizes explain gives the weight M of the prior,
    ``rate = (k + M * m) / (n + M)``. Hosts that don't differ beyond chance
    get the corpus rate.
    """
    single = rules or failures()
    rules = single | {"any": reduce(Column.__or__, single.values())}
    per = measured.where(q(host).isNotNull() & (q(host) != "")).groupBy(q(host).alias("host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(r.cast("long")).alias(f"k_{name}") for name, r in rules.items()])
    total = F.sum("n_docs")
    prior = per.agg(total.alias("_n"), F.count("*").alias("_hosts"), *[
        x for name in rules for x in (
            (F.sum(f"k_{name}") / total).alias(f"m_{name}"),
            (F.sum(F.col(f"k_{name}") * F.col(f"k_{name}") / F.col("n_docs")) / total).alias(f"q_{name}"))])
    joined = per.join(F.broadcast(prior))  # one row
    for name in rules:
        m, n = F.col(f"m_{name}"), F.col("n_docs")
        own = m * (1 - m)
        beyond = F.col(f"q_{name}") - m * m - own * F.col("_hosts") / F.col("_n")
        weight = F.when(beyond > 0, F.greatest(own / beyond - 1, F.lit(1.0))).otherwise(F.col("_n").cast("double"))
        joined = joined.withColumn(f"rate_{name}", (F.col(f"k_{name}") + weight * m) / (n + weight))
    failed = F.greatest(*[F.col(f"rate_{name}") for name in single], F.lit(0.0)) > rate
    failed = failed | (F.col("rate_any") > F.col("m_any") + rate * (1 - F.col("m_any")))
    return joined.select("host", "n_docs", *[f"rate_{name}" for name in rules], failed.alias("host_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
          keys: dict[str, str] | None = None, rate: float = HOST_RATE) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``host_failed`` and ``kept``.

    A document is dropped for its own length or repetition, or for its host.
    The measures (no texts) are checkpointed, so the texts are read once.
    """
    measured = cut(measure(docs, text, {id_col: id_col, "host": host, **(keys or {})}))
    rules = failures()
    hosts = small(cut(host_verdicts(measured, "host", rate, rules).select("host", "host_failed")), BROADCAST_HOSTS)
    base = rules["short"] | rules["repetitive"]
    out = measured.join(hosts, "host", "left")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return out.select(q(id_col), *(keys or {}), *COUNTS, base.alias("base_failed"), "host",
                      host_failed.alias("host_failed"), (~base & ~host_failed).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns. Rows are matched by id and text hash."""
    slim = docs.select(q(id_col).alias("id"), q(text).alias("text"), q(host).alias("source"), F.xxhash64(q(text)).alias("sig"))
    bad = judge(slim, "id", "text", "source", {"sig": "sig"}).where("NOT kept").select(
        F.col("id").alias("bad_id"), F.col("sig").alias("bad_sig")).distinct()
    rows = wrapped(docs, id_col, text)
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("sig") == F.col("bad_sig")), "left_anti").select("row.*")
