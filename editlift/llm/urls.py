"""URL filter: rules first, then a ratio of two character language models.

Accepted and rejected URLs each train a smoothed Markov model of variable order:
a character's probability after its longest context of up to ``ORDER`` characters is
mixed with that after the next shorter one, by Witten-Bell weights, down to a
uniform share. A URL's score is the difference of its two log-likelihoods per
character. The threshold is calibrated on labelled URLs held out by hash: the
score with the least mean of both error rates.

Characters are counted per distinct n-gram before anything is joined, so what
is joined and windowed has one row per distinct n-gram; only the last join
meets the URLs again, as an inner join of which skewed partitions can be split.
Everything is DataFrame functions.

Cases: a null URL is empty, has no host and path, and is scored like an empty text.
Equal URLs get equal verdicts. Without labelled URLs both models are uniform, all scores
are 0 and the verdict is allow. Ties go to allow. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import ascii_lower, staged, text_or_empty

#: Host and path of each rule, and its verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

ORDER = 4
START, END = "\x02", "\x03"
HELD_OUT = 5
BINS = 100


def parts(df: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id, url, host, path)."""
    url = text_or_empty(url_col)
    lead = r"(?s)^.*?://"
    return df.select(
        df[id_col].alias("id"), url.alias("url"),
        ascii_lower(F.regexp_extract(url, lead + r"([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, lead + r"[^/?#]*([^?#]*)", 1).alias("path"),
    )


def ruled(rows: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``; the longest rule that fits wins. Rules are a short fixed list."""

    def fits(rule: str) -> Column:
        host, _, path = rule.partition("/")
        at_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))
        return at_host & F.startswith(F.col("path"), F.lit(f"/{path}"))

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    first = lambda k: F.coalesce(*(F.when(fits(r[0]), F.lit(r[k])) for r in ordered)) if ordered else F.lit(None).cast("string")
    return rows.withColumn("rule", first(0)).withColumn("rule_verdict", first(1))


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of each URL and of its end: the character after its context."""
    padded = F.concat(F.lit(START * ORDER), F.col("url"), F.lit(END))
    at = F.sequence(F.lit(1), F.length("url") + 1)
    return urls.select(*keep, F.explode(F.transform(at, lambda i: F.substr(padded, i, F.lit(ORDER + 1)))).alias("gram"))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, score): difference of log-probabilities, from (gram, n_allow, n_block) over distinct grams."""
    sides = ("allow", "block")
    cut = lambda c, k: F.substr(c, F.lit(ORDER + 1 - k), F.lit(k + 1))
    lower = None
    for k in range(ORDER + 1):
        level = counts.groupBy(cut(F.col("gram"), k).alias("g")).agg(*(F.sum(f"n_{s}").alias(f"n_{s}") for s in sides))
        level = level.withColumn("context", F.substr("g", F.lit(1), F.lit(k))).withColumn("shorter", F.substr("g", F.lit(2), F.lit(k)))
        totals = level.groupBy("context").agg(
            *(F.sum(f"n_{s}").alias(f"t_{s}") for s in sides),
            *(F.sum((F.col(f"n_{s}") > 0).cast("long")).alias(f"d_{s}") for s in sides), F.count("*").alias("alphabet"),
        )
        level = level.join(totals, "context")
        if lower is None:
            below = {s: 1.0 / F.col("alphabet") for s in sides}
        else:
            level = level.join(lower, "shorter")
            below = {s: F.col(f"below_{s}") for s in sides}
        mixed = {
            s: F.when(F.col(f"t_{s}") > 0, (F.col(f"n_{s}") + F.col(f"d_{s}") * below[s]) / (F.col(f"t_{s}") + F.col(f"d_{s}"))).otherwise(below[s])
            for s in sides
        }
        if k == ORDER:
            return level.select(F.col("g").alias("gram"), (F.log(mixed["allow"]) - F.log(mixed["block"])).alias("score"))
        lower = level.select(F.col("g").alias("shorter"), *(mixed[s].alias(f"below_{s}") for s in sides))
    raise AssertionError


def scored(urls: DataFrame) -> DataFrame:
    """(url, score) from distinct URLs with ``side`` (allow, block or null): per character, trained on rows not held out."""
    trains = (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) > 0) & F.col("side").isNotNull()
    weight = lambda s: F.sum((F.col("trains") & (F.col("side") == s)).cast("long"))
    counted = grams(urls.withColumn("trains", F.coalesce(trains, F.lit(False))), "side", "trains").groupBy("gram").agg(
        *(F.coalesce(weight(s), F.lit(0)).alias(f"n_{s}") for s in ("allow", "block"))
    )
    scores = gram_scores(staged(counted, "url-grams"))
    return grams(urls, "url").join(scores, "gram").groupBy("url").agg((F.sum("score") / F.count("*")).alias("score"))


def threshold(known: DataFrame) -> float:
    """Calibrated on held-out (side, score): counts per hundredth, clipped to +-20, so at most 4,001 rows reach the driver."""
    bins = (
        known.where((F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0) & F.col("side").isNotNull())
        .groupBy(F.floor(F.least(F.greatest(F.col("score"), F.lit(-20.0)), F.lit(20.0)) * BINS).alias("bin"), "side").count().collect()
    )
    total = {s: sum(r["count"] for r in bins if r["side"] == s) for s in ("allow", "block")}
    if not all(total.values()):
        return 0.0

    def error(cut: int) -> float:
        wrong_allow = sum(r["count"] for r in bins if r["side"] == "allow" and r["bin"] < cut) / total["allow"]
        wrong_block = sum(r["count"] for r in bins if r["side"] == "block" and r["bin"] >= cut) / total["block"]
        return wrong_allow + wrong_block

    cuts = sorted({0, *(r["bin"] for r in bins), *(r["bin"] + 1 for r in bins)}, key=abs)
    return reduce(lambda a, b: b if error(b) < error(a) else a, cuts) / BINS


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row."""
    rows = ruled(parts(df, id_col, url_col), rules)
    distinct = rows.groupBy("url").agg(F.first("rule_verdict").alias("side"))
    known = staged(distinct.join(scored(distinct), "url"), "url-scores")
    cut = threshold(known)
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return rows.join(known.select("url", "score"), "url", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score")
    )
