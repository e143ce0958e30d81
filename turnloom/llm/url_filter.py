"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

Everything that touches rows is a DataFrame expression. The trees are fitted on the driver from a bounded sample
of labelled URLs and then compiled to nested CASE expressions.

Labels: those given, else the URLs that a rule decides. In the latter case a label restates the rule, that is the host's suffix
and the path's first part, so neither is a feature: of a suffix it is only told how common it is, by powers of ten, not
how many of its URLs are blocked. With labels of its own the trees also see the share of blocked URLs among the other
hosts of the suffix, never that of the URL's own host. Both kinds weigh alike in the fit. From which score on a URL is blocked is
told by precision on hosts that a fit has not seen: where the features say nothing about the labels of other hosts, as rules by host
and language leave it, no URL is blocked for its score.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import cut, drawn

#: (verdict, host/path prefix): a rule fits its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs that the trees are fitted on: about this many, twice as many at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 16, 3
#: A suffix's share of blocked URLs counts as if this many more URLs had the overall share.
PRIOR = 20.0
#: No URL below this score is blocked; both kinds weigh alike, so 0.5 says nothing.
THRESHOLD = 0.8
#: Parts of the hosts that are scored by a fit on the others; normal deviate of the bound of precision there.
FOLDS, Z = 5, 2.33
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no :// gives ''."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; equally long rules: the first named."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of a host, without port."""
    return F.substring_index(F.regexp_replace(host, r":\d*$", ""), ".", -2)


def _count(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, of, ""))).cast("double")


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """Lexical features of a URL; a null URL has those of an empty one."""
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    kinds = F.array_distinct(F.split(text, ""))
    times = F.transform(F.filter(kinds, lambda c: c != ""), lambda c: (F.length(text) - F.length(F.replace(text, c))) / F.length(c) / n)
    entropy = F.aggregate(times, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return [
        F.length(text).cast("double"),
        F.length(host).cast("double"),
        F.length(path).cast("double"),
        F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        _count(text, "[0-9]") / n,
        _count(host, "[0-9]"),
        _count(host, "-"),
        _count(host, r"\."),
        entropy,
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0),
        _count(text, r"[^A-Za-z0-9:/.?&=#_-]"),
        F.when(text.startswith("https"), 1.0).otherwise(0.0),
        F.when(path.rlike(r"\.[A-Za-z0-9]{1,5}$"), 1.0).otherwise(0.0),
        F.when(text.contains("#"), 1.0).otherwise(0.0),
    ]


def with_features(rows: DataFrame, labelled: DataFrame | None) -> DataFrame:
    """rows (url, host, path, suffix) with x, their features. labelled (host, suffix, blocked): labels that are no rules'."""
    common = cut(rows.groupBy("suffix").agg(F.count("*").alias("seen")).withColumnRenamed("suffix", "of_suffix"))
    out = rows.join(common, rows.suffix == common.of_suffix, "left").drop("of_suffix")
    extra = [F.floor(F.log10(F.coalesce("seen", F.lit(1)))).cast("double")]
    if labelled is not None:
        bad = F.sum(F.col("blocked").cast("int")).alias
        hosts = cut(labelled.groupBy("suffix", "host").agg(F.count("*").alias("n_host"), bad("bad_host")))
        suffixes = hosts.groupBy(F.col("suffix").alias("s")).agg(F.sum("n_host").alias("n"), F.sum("bad_host").alias("bad"))
        whole = hosts.agg(F.sum("n_host").alias("n"), F.sum("bad_host").alias("bad")).first()
        base = (whole["bad"] or 0) / (whole["n"] or 1)
        out = out.join(suffixes, out.suffix == suffixes.s, "left").drop("s")
        hosts = hosts.select(F.col("host").alias("h"), "n_host", "bad_host")
        out = out.join(hosts, out.host == hosts.h, "left").drop("h")
        of = lambda c: F.coalesce(c, F.lit(0))
        extra.append((of("bad") - of("bad_host") + PRIOR * base) / (of("n") - of("n_host") + PRIOR))
    return out.select(*rows.columns, F.array(*lexical(F.col("url"), F.col("host"), F.col("path")), *extra).alias("x"))


def fit(known: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = THRESHOLD) -> tuple[float, list[trees.Node], float | None]:
    """Offset, trees and the score to block from, from rows (url, host, x, blocked), a bounded sample of them.

    The score to block from is safe_score() of scores by fits on other hosts. One kind of label, or none: no trees, offset 0, no such score.
    """
    rows = known.select("url", "host", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"), F.col("blocked").cast("int").alias("y"), "x")
    got = drawn(rows, F.col("url"), sample_rows, known.count()).select("x", "y", "fold", "host").collect()
    y = np.array([r["y"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return 0.0, [], None
    x = np.array([r["x"] for r in got], float)
    fold, host = np.array([r["fold"] for r in got]), np.unique([r["host"] for r in got], return_inverse=True)[1]
    order = np.lexsort((host, *x.T, y))  # rows come in any order; the fit must not depend on it
    x, y, fold, host = x[order], y[order], fold[order], host[order]
    return *_boosted(x, y), safe_score(other_hosts_scores(x, y, fold), y, host, least)


def _boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, list[trees.Node]]:
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    return trees.boost(x, y, weight, TREES, DEPTH)


def other_hosts_scores(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Each row's score by a fit on the rows of other folds; 0.5 where those are of one kind."""
    out = np.full(len(y), 0.5)
    for f in np.unique(fold):
        rest = fold != f
        if rest.any() and y[rest].min() < y[rest].max():
            offset, grown = _boosted(x[rest], y[rest])
            out[~rest] = 1 / (1 + np.exp(-offset - sum(trees.apply(t, x[~rest]) for t in grown)))
    return out


def safe_score(scores: np.ndarray, y: np.ndarray, host: np.ndarray, least: float = THRESHOLD) -> float | None:
    """The smallest score from `least` on, in hundredths, at which blocking is right for other hosts; None if there is none.

    Right: the lower bound of precision (Wilson's, deviate Z) is at least halfway from the share of blocked URLs to 1. URLs of one
    host are no independent cases, so the bound counts hosts.
    """
    goal = (1 + y.mean()) / 2
    for at in np.append(np.arange(least, 1, 0.01), 1.0):
        over = scores >= at
        n = len(np.unique(host[over]))
        if n:
            p, zz = y[over].mean(), Z * Z
            if (p + zz / (2 * n) - Z * np.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n) >= goal:
                return float(at)
    return None


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, *, url_col: str = "url", keep: Sequence[str] = (),
    rules: Sequence[tuple[str, str]] = RULES, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD,
) -> DataFrame:
    """keep, host, path, rule, verdict, score (of blocking) for each row of pages.

    labelled: rows (url, blocked boolean) to learn from; without it, the URLs that a rule decides are the labels.
    A null URL or one without :// has an empty host and path, fits no rule and is judged by its features. A URL that ends
    with its host has an empty path, which starts with no rule's path, so no rule fits it. Repeated rows are judged alike, an
    empty table gives an empty one. With no labelled URL, or one kind only, nothing can be told apart: score 0.5, allowed. Nor is a URL
    blocked for its score where blocking has not proved right on other hosts than the trees were fitted on: see safe_score().
    Columns of pages that are not in keep are not read, whatever their names.
    """
    rows = pages.select(F.struct(*keep).alias("kept"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix_of(F.col("host")))
    own = None
    if labelled is not None:
        own = labelled.where(F.col("blocked").isNotNull()).select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked")
        own = own.withColumn("suffix", suffix_of(F.col("host")))
    marked = with_features(rows, own)
    known = marked.where(F.col("found").isNotNull()).withColumn("blocked", F.col("found.verdict") == "block") if own is None else with_features(own, own)
    offset, grown, at = fit(known, sample_rows, threshold)
    features = [F.get("x", F.lit(i)) for i in range(64)]
    total = F.lit(offset)
    for tree in grown:
        total = total + trees.as_column(tree, features)
    scored = marked.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    guess = F.lit("allow") if at is None else F.when(F.col("score") >= at, "block").otherwise("allow")
    return scored.select("kept.*", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", guess).alias("verdict"), F.round("score", 6).alias("score"))
