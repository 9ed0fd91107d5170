"""Quality rules with host-level verdicts (native: DataFrame functions only).

Every document is measured in place by array functions, so no shuffle carries
words.  Failures are counted by host (partial aggregation first), each host's
rate is shrunk by a beta prior fitted to all hosts, and a host is rejected, with all
its documents, if even the lower credible bound of its rate stands for ``ODDS``
times the odds of failure that the prior expects.  So the verdict follows the
corpus: where hosts don't differ by more than chance, none is rejected.

Defined results: a null text has no words and fails (too short); texts of any
length are measured whole; a null host is a host of its own; ids may be null or
repeated, rows are judged as separate documents; an empty table gives an empty
result; all other columns pass through, and measures whose names clash with a
column of the input go to names with leading underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Odds of failure, times those of the corpus, beyond which a host is rejected; standard deviations below the mean at which its rate is taken.
ODDS, SURE = 4.0, 1.645
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return C.let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long")


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as ``m_<name>``.

    n_repeat_words: windows of three words are sorted by a hash whose low bits
    hold the position, so repeated windows are neighbours; a neighbour is
    compared by its words, and a text in which two windows share a hash but not
    their words is sorted by the words themselves.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.withColumn("m_w", C.words(F.col(f"`{text}`")))
    df = df.withColumn("m_n_words", F.size("m_w").cast("long"))
    bits = F.length(F.bin(F.size("m_w"))).cast("int")
    packed = F.transform(
        F.slice("m_w", 1, F.greatest(F.size("m_w") - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get("m_w", i + 1), F.get("m_w", i + 2)), F.col("m_k")).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("m_k", bits).withColumn("m_s", F.sort_array(packed))
    high = lambda x: F.call_function("shiftright", x, F.col("m_k"))
    near = lambda x, i: (high(x) == high(F.get("m_s", i - 1))) | (high(x) == high(F.get("m_s", i + 1)))
    df = df.withColumn("m_c", F.filter("m_s", lambda x, i: F.coalesce(near(x, i), F.lit(False))))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m_k")) - 1).cast("int")
    three = lambda p: F.slice("m_w", p + 1, 3)
    clash = F.exists(
        F.sequence(F.lit(1), F.size("m_c") - 1),
        lambda j: (high(F.get("m_c", j)) == high(F.get("m_c", j - 1))) & (three(at(F.get("m_c", j))) != three(at(F.get("m_c", j - 1)))),
    )
    by_words = C.let(
        F.sort_array(F.transform("m_c", lambda x: F.struct(three(at(x)).alias("w"), at(x).alias("i")))),
        lambda v: F.transform(F.filter(v, lambda x, i: F.coalesce((x["w"] == F.get(v, i - 1)["w"]) | (x["w"] == F.get(v, i + 1)["w"]), F.lit(False))), lambda x: x["i"]),
    )
    found = F.when(F.size("m_c") < 2, F.array().cast("array<int>")).otherwise(F.when(clash, by_words).otherwise(F.transform("m_c", at)))
    df = df.withColumn("m_p", F.sort_array(found))
    step = F.transform("m_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("m_p", i + 1) - x, F.lit(3))).cast("long"))
    df = df.withColumn("m_n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumn("m_word_chars", F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"))
    df = df.withColumn("m_n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("m_n_dup_lines", _dup_lines(t))
    df = df.withColumn("m_base_failed", (F.col("m_n_words") < MIN_WORDS) | (100 * F.col("m_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m_n_words")))
    return df.drop("m_w", "m_k", "m_s", "m_c", "m_p")


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(m_host, n_docs, n_failed, rate, bound, top): each host's failure rate, shrunk by a beta prior, its lower credible bound, and the limit for it.

    The prior's mean is the rate of all documents; its weight (alpha + beta)
    comes from the weighted variance of the hosts' rates less what binomial
    noise explains.  Where noise explains it all, hosts shrink fully.
    """
    by = measured.groupBy(F.col(f"`{host}`").alias("m_host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("m_base_failed").cast("long")).alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    total = by.agg(F.sum("n_docs").cast("double").alias("t_n"), F.sum("n_failed").cast("double").alias("t_f"), F.count(F.lit(1)).cast("double").alias("t_h"), F.sum(f * f / n).alias("t_ff"))
    mu = F.col("t_f") / F.col("t_n")
    spread = F.greatest(F.col("t_ff") / F.col("t_n") - mu * mu, F.lit(0.0))
    noise = mu * (1 - mu) * F.col("t_h") / F.col("t_n")
    weight = F.when(spread > noise, F.least(F.greatest((mu * (1 - mu) - spread) / (spread - noise), F.lit(1.0)), F.lit(1e9))).otherwise(1e9)
    prior = total.select(mu.alias("t_mu"), weight.alias("t_weight"))  # one row
    rate, size, mean = F.col("rate"), n + F.col("t_weight"), F.col("t_mu")
    by = by.crossJoin(F.broadcast(prior)).withColumn("rate", (f + mean * F.col("t_weight")) / size)
    bound = rate - SURE * F.sqrt(rate * (1 - rate) / (size + 1))
    return by.select("m_host", "n_docs", "n_failed", "rate", bound.alias("bound"), (ODDS * mean / (1 - mean + ODDS * mean)).alias("top"))


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with the measures, base_failed, host_rate and kept.

    The measured rows are written once to the shared folder: the host counts
    and the result both read them.
    """
    hidden, names = C.hide(docs)
    measured = C.stage(with_measures(hidden, names[text]), "measured")
    return _verdicts(measured, names, names[host], docs)


def judge_measures(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """As ``judge`` without the texts, so that only ids, hosts and measures are written between."""
    hidden, names = C.hide(docs)
    measured = C.stage(with_measures(hidden, names[text]).drop(names[text]), "measured")
    return _verdicts(measured, {c: n for c, n in names.items() if c != text}, names[host], docs)


def _verdicts(measured: DataFrame, names: dict[str, str], host: str, docs: DataFrame) -> DataFrame:
    clash = {c: C.free_name(docs, c) for c in (*MEASURES, "base_failed", "host_rate", "kept")}
    rates = host_rates(measured, host).select(F.col("m_host").alias(host), F.col("rate").alias("m_rate"), (F.col("bound") > F.col("top")).alias("m_bad"))
    out = C.join_lookup(measured, rates, host, row_bytes=2048)
    kept = ~F.col("m_base_failed") & ~F.col("m_bad")
    return out.select(
        *C.shown(names),
        *(F.col(f"m_{c}").alias(clash[c]) for c in (*MEASURES, "base_failed")),
        F.col("m_rate").alias(clash["host_rate"]),
        kept.alias(clash["kept"]),
    )
