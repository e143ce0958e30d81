"""Quality rules: a decision list learnt from labelled statistics, all of it Spark columns.

Sequential covering on a bounded labelled sample grows one conjunction of thresholds at a time for either verdict, prunes it
on rows that it was not grown on, and takes what it covers out. What comes of it is an ordered CASE over statistics of the
text that built-in functions compute.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drawn, free_name

#: Labelled rows that a list is learnt from: about this many, twice as many at most.
SAMPLE_ROWS = 20_000
#: Rules of a list, conditions of a rule, thresholds that are tried for a feature, rows that a rule must cover among those it is pruned on.
MOST_RULES, MOST_CONDITIONS, CUTS, LEAST_COVER = 16, 4, 48, 8
#: A rule is taken if the lower bound of its precision (95 %) on the rows it is pruned on reaches this.
SURE = 0.8
#: Texts with fewer words, or with more than this percentage of their words in repeated windows, fail before any rule.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "words", "mean_word", "symbols_per_word", "marks_per_word", "upper_share", "digit_share", "distinct_words", "repeated_words",
    "repeated_lines", "words_per_line",
)


def with_statistics(docs: DataFrame, *, text_col: str = "text", as_col: str = "stats") -> DataFrame:
    """docs with a struct of COUNTS (long) and of FEATURES (double, in an array `features`), from whole texts; null counts as empty.

    Each step is a projection of its own whose columns are used more than once, so Spark doesn't merge it into the next and
    an array is computed once. A window's words are known by 64-bit hashes within their own text. Repeated windows are neighbours
    once hashes are sorted, so the work is that of a sort, whatever repeats; texts without any are not sorted.
    """
    keep = [F.col(c) for c in docs.columns]
    made: dict[str, str] = {}

    def new(name: str) -> str:
        made[name] = free_name(name, [*docs.columns, *made.values(), as_col])
        return made[name]

    def c(name: str) -> Column:
        return F.col(made[name])

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(*keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias(new("w")), F.split(text, "\n").alias(new("lines")))
    filled = F.filter(c("lines"), lambda x: x.rlike(WORD))

    def without(pattern: str) -> Column:
        """Characters of the text that match."""
        return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))

    out = out.select(
        *keep, F.transform(c("w"), lambda x: F.xxhash64(x)).alias(new("h")), F.size(c("w")).cast("long").alias(new("n_words")),
        F.length(F.array_join(c("w"), "")).cast("long").alias(new("word_chars")), filled.alias(new("filled")),
        without(SYMBOL).cast("long").alias(new("n_symbols")), without(r"[!-/:-@\[-`{-~]+").alias(new("marks")),
        without("[A-Z]+").alias(new("upper")), without("[0-9]+").alias(new("digits")),
    )
    hashes = c("h")
    grams = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    numbers = ["n_words", "word_chars", "n_symbols", "marks", "upper", "digits"]
    out = out.select(
        *keep, *[c(n) for n in numbers], grams.alias(new("g")), F.size(F.array_distinct(hashes)).alias(new("kinds")),
        F.size(c("filled")).alias(new("n_lines")), F.size(F.array_distinct(c("filled"))).alias(new("n_kinds")),
    )
    numbers += ["kinds", "n_lines", "n_kinds"]
    repeated = F.size(F.array_distinct(c("g"))) < F.size(c("g"))
    placed = F.when(repeated, F.sort_array(F.transform(c("g"), lambda x, i: F.struct(x.alias("g"), i.alias("i")))))
    out = out.select(*keep, *[c(n) for n in numbers], placed.alias(new("s")))
    s = c("s")

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))

    out = out.select(*keep, *[c(n) for n in numbers], F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])).alias(new("p")))
    p = c("p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + 1) - x)), F.lit(0), lambda a, x: a + x)
    out = out.select(*keep, *[c(n) for n in numbers], F.coalesce(covered, F.lit(0)).cast("long").alias(new("n_repeat_words")))
    n, lines = F.greatest(c("n_words"), F.lit(1)).cast("double"), F.greatest(c("n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(c("word_chars"), F.lit(1)).cast("double")
    dup = (c("n_lines") - c("n_kinds")).cast("long")
    features = F.array(
        c("n_words").cast("double"), c("word_chars") / n, c("n_symbols") / n, c("marks") / n, c("upper") / chars, c("digits") / chars, c("kinds") / n,
        c("n_repeat_words") / n, dup / lines, n / lines,
    )
    counts = [dup.alias(k) if k == "n_dup_lines" else c(k).alias(k) for k in COUNTS]
    # A filter on what follows stops at a generator; through plain projections it would be written out in terms of the text, arrays in arrays.
    return out.select(*keep, F.explode_outer(F.array(F.struct(*counts, features.alias("features")))).alias(as_col))


def base_failed(stats: Column, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    """Too short, or too many of its words in windows that repeat."""
    return (stats["n_words"] < least_words) | (stats["n_repeat_words"] * 100 > stats["n_words"] * most_repeated)


@dataclass
class Rule:
    """(feature, above, at), ... all hold: the verdict."""

    conditions: tuple
    keep: bool
    covered: int = 0
    precision: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, at in self.conditions:
            out &= (x[:, f] > at) == above
        return out

    def column(self, features: Column) -> Column:
        out = F.lit(True)
        for f, above, at in self.conditions:
            value = F.get(features, F.lit(f))
            out = out & ((value > F.lit(at)) if above else (value <= F.lit(at)))
        return out

    def __str__(self) -> str:
        said = " and ".join(f"{FEATURES[f]} {'>' if above else '<='} {at:.4g}" for f, above, at in self.conditions)
        return f"{'keep' if self.keep else 'drop'} if {said}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds decides, else the default."""

    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def decide(self, x: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(x), self.default), np.ones(len(x), bool)
        for rule in self.rules:
            hit = open_ & rule.holds(x)
            out[hit] = rule.keep
            open_ &= ~hit
        return out

    def _case(self, features: Column, of, other: Column) -> Column:
        out = None
        for rule in self.rules:
            out = (F if out is None else out).when(rule.column(features), of(rule))
        return other if out is None else out.otherwise(other)

    def keep(self, features: Column) -> Column:
        """The verdict over an array column of FEATURES."""
        return self._case(features, lambda r: F.lit(r.keep), F.lit(self.default))

    def reason(self, features: Column) -> Column:
        """The rule that decides, in words."""
        return self._case(features, lambda r: F.lit(str(r)), F.lit(f"default: {'keep' if self.default else 'drop'}"))


def _sure(hits: int, rows: int) -> float:
    """Lower 95 % bound of a share."""
    if not rows:
        return 0.0
    z, share = 1.96, hits / rows
    return float((share + z * z / (2 * rows) - z * np.sqrt(share * (1 - share) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows))


def _grow(x: np.ndarray, hit: np.ndarray) -> list[tuple]:
    """Conditions in the order in which they gain most information about hit; gain is counted on the rows still covered."""
    inside, found = np.ones(len(x), bool), []
    while len(found) < MOST_CONDITIONS and not hit[inside].all():
        p0, all0 = hit[inside].sum(), inside.sum()
        best, condition = 1e-9, None
        for f in range(x.shape[1]):
            own = x[inside, f]
            for at in np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")):
                above = own > at
                for side, rows in ((True, above), (False, ~above)):
                    n, p = rows.sum(), hit[inside][rows].sum()
                    if not p or n == all0:
                        continue
                    gain = p * (np.log2(p / n) - np.log2(p0 / all0))
                    if gain > best:
                        best, condition = gain, (f, side, float(at))
        if condition is None:
            break
        found.append(condition)
        inside &= (x[:, condition[0]] > condition[2]) == condition[1]
    return found


def _prune(conditions: list[tuple], keep: bool, x: np.ndarray, hit: np.ndarray) -> Rule | None:
    """The beginning of the conditions that is surest on other rows; of equal ones the shortest."""
    best = None
    for n in range(1, len(conditions) + 1):
        rule = Rule(tuple(conditions[:n]), keep)
        inside = rule.holds(x)
        rule.covered, rule.precision = int(inside.sum()), _sure(int(hit[inside].sum()), int(inside.sum()))
        if rule.covered >= LEAST_COVER and (best is None or rule.precision > best.precision):
            best = rule
    return best


def learn(x: np.ndarray, good: np.ndarray) -> DecisionList:
    """A list from rows of FEATURES and labels. Two of three rows grow a rule, the third prunes it. No rows: everything is kept.

    Rows that no rule decides follow the larger part of the labelled rows left, and are kept if none is left or both are equal."""
    order = np.lexsort((*x.T, good))  # rows come in any order, what is learnt must not depend on it
    x, good = x[order], good[order].astype(bool)
    prune = np.arange(len(x)) % 3 == 2
    rules, left = [], np.ones(len(x), bool)
    while len(rules) < MOST_RULES and good[left].any() and not good[left].all():
        grow, test = left & ~prune, left & prune
        found = []
        for keep in (False, True):
            hit = good == keep
            if hit[grow].any():
                found.append(_prune(_grow(x[grow], hit[grow]), keep, x[test], hit[test]))
        found = [r for r in found if r is not None and r.precision >= SURE]
        if not found:
            break
        rules.append(max(found, key=lambda r: (r.precision, not r.keep)))
        left &= ~rules[-1].holds(x)
    rest = good[left]
    return DecisionList(rules, bool(not len(rest) or 2 * rest.sum() >= len(rest)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A list from the documents that labels names, about sample_rows of them and twice as many at most, drawn by the hash of the id.

    Labels other than 0 and 1 and null ids are not used, repeated labels count once; an id with both labels is an example of each.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).distinct()
    few = drawn(known, F.col("k"), sample_rows, known.count())  # two numbers a row, 2 x sample_rows rows at most
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    rows = cut(with_statistics(own.join(F.broadcast(few), "k"), text_col="t").select("k", "y", F.col("stats.features").alias("x")))
    got = drawn(rows, F.xxhash64("k"), sample_rows, rows.count()).collect()  # ids may repeat among documents
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r["y"] for r in got], int) == 1)


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text", as_col: str = "judged") -> DataFrame:
    """docs with a struct of COUNTS, base_failed, kept (base_failed: false, else what the list says) and reason (null if base_failed).

    Null and empty texts have no words and fail. Repeated rows are judged alike; other columns, whatever their names, stay as they are.
    """
    stats = free_name("stats", [*docs.columns, as_col])
    failed = free_name("failed", [*docs.columns, as_col, stats])
    out = with_statistics(docs, text_col=text_col, as_col=stats)
    out = out.withColumn(failed, base_failed(F.col(stats)))
    features = F.col(stats)["features"]
    kept = F.when(F.col(failed), F.lit(False)).otherwise(rules.keep(features))
    reason = F.when(~F.col(failed), rules.reason(features))
    return out.select(
        *docs.columns,
        F.struct(*[F.col(stats)[k].alias(k) for k in COUNTS], F.col(failed).alias("base_failed"), kept.alias("kept"), reason.alias("reason")).alias(as_col),
    )
