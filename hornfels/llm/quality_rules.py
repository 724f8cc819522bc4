"""Quality rules with verdicts on hosts: failures by domain, shrunk by an empirical beta prior.

Every document is measured by native functions in one pass. Failures of each rule are counted by host; a beta
prior is fitted to the hosts' rates by moments, and a host's rate has the posterior of that prior, so that a host
with a few documents is not judged by chance. Verdicts are relative to the prior and are joined back to the documents:
a host is bad on a rule where its rate is surely above ``WORSE`` times the prior's mean, and loses all of its documents;
on the soft rules (symbols, lines) every host has a limit of its own, the rule's limit times the prior's mean over the host's
shrunk rate (within ``LENIENT``), so the same document stays at a host that rarely fails the rule and goes at one that often does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfels.llm.common import WORD, key_of, read_table
from hornfels.storage import materialise

#: Fixed values of the base rules and of what counts as a symbol.
SYMBOLS, MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = "#*$%&|<>", 10, 5, 20
#: Soft rules on top: symbols a word character, and lines that repeat an earlier one, in per cent.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: Multiple of the prior's mean for bad hosts, deviations of the posterior that make it sure, and by how much a host's limit differs at most.
WORSE, SURE, LENIENT = 3.0, 2.0, 2.0
RULES, SOFT = ("short", "repeats", "symbols", "lines"), ("symbols", "lines")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(grams: Column, n: Column) -> Column:
    """Words in windows that occur twice or more; grams: the windows' hashes by position."""

    def spans(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def doubled(s: Column) -> Column:
        m = F.size(s)
        same = F.filter(F.sequence(F.lit(0), m - 1), lambda i: ((i > 0) & (s[i]["h"] == s[F.greatest(i - 1, F.lit(0))]["h"])) | ((i < m - 1) & (s[i]["h"] == s[F.least(i + 1, m - 1)]["h"])))
        return _let(F.sort_array(F.transform(same, lambda i: s[i]["i"])), spans)

    hashed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when((n < WINDOW) | (F.size(F.array_distinct(grams)) == F.size(grams)), F.lit(0).cast("long")).otherwise(_let(hashed, doubled))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each document. Null text counts as empty; every column may be null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col("source").alias("host"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    counted = split.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        grams.alias("grams"),
    )
    counted = counted.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": _covered(F.col("grams"), F.col("n_words")),
    })
    return counted.drop("lines", "grams")


#: What each soft rule counts, out of what, and its limit in per cent.
GRADED = {"symbols": ("n_symbols", "word_chars", MAX_SYMBOL_PERCENT), "lines": ("n_dup_lines", "n_lines", MAX_DUP_LINE_PERCENT)}


def _over(rule: str, limit: Column) -> Column:
    part, whole, _ = GRADED[rule]
    return 100 * F.col(part) > limit * F.col(whole)


def failures() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        **{r: _over(r, F.lit(GRADED[r][2])) for r in SOFT},
    }


def beta_prior(hosts: DataFrame, rule: str) -> list[Column]:
    """Sums over hosts from which ``fit_prior`` takes the prior's two moments."""
    rate = F.col(rule) / F.col("n")
    return [F.sum(rule).alias(f"{rule}_k"), F.sum(F.col("n") * rate * rate).alias(f"{rule}_q")]


def fit_prior(k: float, q: float, n: float, hosts: int) -> tuple[float, float]:
    """Alpha and beta by moments, rates weighted by documents; binomial noise is taken off the variance."""
    mean = k / n if n else 0.0
    noise = mean * (1 - mean) * hosts / n if n else 0.0
    spread = max((q / n - mean * mean if n else 0.0) - noise, 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    return max(mean, 1e-6) * strength, max(1 - mean, 1e-6) * strength


def host_verdicts(measured: DataFrame, worse: float = WORSE, sure: float = SURE, lenient: float = LENIENT) -> DataFrame:
    """host_key, n, and for each rule the shrunk rate and whether the host is bad on it; the soft rules' limits in per cent; ``host_ok``: bad on none.

    A rule's posterior is the beta distribution of the prior and the host's counts. The priors are four pairs of
    numbers from sums over the hosts.
    """
    fails = failures()
    hosts = measured.groupBy(key_of("host").alias("host_key")).agg(F.count("*").alias("n"), *[F.sum(fails[r].cast("long")).alias(r) for r in RULES])
    hosts = materialise(hosts, "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[c for r in RULES for c in beta_prior(hosts, r)]).first()
    verdicts = {}
    for r in RULES:
        a, b = fit_prior(float(total[f"{r}_k"] or 0), float(total[f"{r}_q"] or 0), float(total["n"] or 0), total["hosts"])
        rate = (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b))
        margin = F.lit(sure) * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(a + b + 1)))
        verdicts |= {f"{r}_rate": rate, f"{r}_bad": rate - margin > F.lit(worse * a / (a + b))}
        if r in GRADED:
            verdicts[f"{r}_limit"] = F.least(F.greatest(F.lit(a / (a + b)) / rate, F.lit(1 / lenient)), F.lit(lenient)) * GRADED[r][2]
    hosts = hosts.withColumns(verdicts)
    return hosts.withColumn("host_ok", ~F.greatest(*[F.col(f"{r}_bad") for r in RULES]))


def apply_rules(docs: DataFrame, worse: float = WORSE, sure: float = SURE, lenient: float = LENIENT) -> DataFrame:
    """Counts, base_failed, the host's verdicts and kept, a row for each row of ``docs`` (repeats included).

    Null text is empty and so fails; a null host is a host of its own. An empty table gives an empty result. Of
    the columns of ``docs`` only ``doc_id`` and ``source`` (as ``host``) are in it, so none can clash.
    """
    measured = materialise(measure(docs), "measured").withColumn("host_key", key_of("host"))
    verdicts = host_verdicts(measured, worse, sure, lenient).select("host_key", "host_ok", *[f"{r}_limit" for r in SOFT])
    fails = failures()
    out = measured.withColumn("base_failed", fails["short"] | fails["repeats"]).join(verdicts, "host_key")
    kept = ~F.col("base_failed") & F.col("host_ok")
    for r in SOFT:
        kept = kept & ~_over(r, F.col(f"{r}_limit"))
    return out.withColumn("kept", kept).drop("host_key")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '{_W}') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM d
), g AS (
  SELECT rid, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM s)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
), cover AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid
), m AS (
  SELECT s.rid, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM s LEFT JOIN cover ON s.rid = cover.rid
), f AS (
  SELECT *, (n_words < 10)::INT AS f1, (100 * n_repeat_words > 20 * n_words)::INT AS f2,
         (100 * n_symbols > 10 * word_chars)::INT AS f3, (100 * n_dup_lines > 30 * n_lines)::INT AS f4 FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, unnest([1, 2, 3, 4]) AS r, unnest([sum(f1), sum(f2), sum(f3), sum(f4)])::DOUBLE AS k FROM f GROUP BY source
), p AS (
  SELECT r, sum(k) / sum(n) AS mu, sum(k * k / n) / sum(n) AS q, count(*) / sum(n) AS per FROM h GROUP BY r
), prior AS (
  SELECT r, mu, least(greatest(mu * (1 - mu) / greatest(q - mu * mu - mu * (1 - mu) * per, 1e-6) - 1, 1.0), 1e4) AS strength FROM p
), v AS (
  SELECT source, r, (k + greatest(mu, 1e-6) * strength) / (n + (greatest(mu, 1e-6) + greatest(1 - mu, 1e-6)) * strength) AS rate,
         n + (greatest(mu, 1e-6) + greatest(1 - mu, 1e-6)) * strength + 1 AS weight, greatest(mu, 1e-6) / (greatest(mu, 1e-6) + greatest(1 - mu, 1e-6)) AS mean
  FROM h JOIN prior USING (r)
), ok AS (
  SELECT source, NOT bool_or(rate - 2 * sqrt(rate * (1 - rate) / weight) > 3 * mean) AS host_ok,
         max(least(greatest(mean / rate, 0.5), 2.0) * 10) FILTER (r = 3) AS limit3, max(least(greatest(mean / rate, 0.5), 2.0) * 30) FILTER (r = 4) AS limit4
  FROM v GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 + f2 > 0) AS base_failed,
       (f1 + f2 = 0 AND host_ok AND NOT 100 * n_symbols > limit3 * word_chars AND NOT 100 * n_dup_lines > limit4 * n_lines) AS kept
FROM f JOIN ok ON f.source IS NOT DISTINCT FROM ok.source
"""
