"""Quality rules: a learned decision list over row-local text statistics, as ordered Spark conditions.

Everything is a DataFrame expression. The statistics of a text need no shuffle. Sequential covering grows one
conjunction of thresholds after the other: every step is one aggregate of the labelled rows still
uncovered, counted by (statistic, threshold bin); the driver only sees those counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrane.llm.common import fenced, table, text_or_empty, words_of
from terrane.session import Stored

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Low bits of a sorted value that hold the place of a window; a text has fewer words than 2 to this power.
PLACE_BITS = 30
#: Statistics that a learned condition may use.
FEATURES = (
    "n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share",
    "upper_share", "digit_share", "mark_share", "words_per_line",
)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the shares made from them; a null text counts as empty.

    Repeated windows are found inside the row. Hash prefixes of the windows are sorted with their places;
    windows with a neighbour of the same prefix are compared by their words, so a hash decides nothing.
    """
    t = F.col("_t")
    df = fenced(docs, _t=text_or_empty(text))
    df = fenced(df, _w=words_of(t), _lines=F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    w = F.col("_w")
    prefixes = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.shiftleft(F.xxhash64(w[i], w[i + 1], w[i + 2]), PLACE_BITS).bitwiseOR(i.cast("long"))))
    df = fenced(df, _sorted=F.sort_array(prefixes))
    before = lambda c, i: F.col(c)[F.greatest(i - 1, F.lit(0))]
    pairs = F.filter(F.transform("_sorted", lambda x, i: F.when(
        (i > 0) & (F.shiftrightunsigned(x.bitwiseXOR(before("_sorted", i)), PLACE_BITS) == 0), F.array(before("_sorted", i), x))), lambda x: x.isNotNull())
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    df = fenced(df, _maybe=F.array_distinct(F.transform(F.flatten(pairs), place)))
    df = fenced(df, _maybe=F.sort_array(F.transform("_maybe", lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("s"), i.alias("p")))))
    twins = F.transform("_maybe", lambda x, i: F.when((i > 0) & (x["s"] == before("_maybe", i)["s"]), F.array(before("_maybe", i)["p"], x["p"])))
    df = fenced(df, _at=F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.when(i == F.size("_at") - 1, F.lit(3)).otherwise(
            F.least(F.lit(3), F.col("_at")[F.least(i + 1, F.size("_at") - 1)] - p))),
        F.lit(0), lambda a, b: a + b,
    )
    count = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    df = fenced(
        df, n_words=F.size("_w").cast("long"), word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=count("[#*$%&|<>]+").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"),
        _lines_n=F.size("_lines"), _distinct=F.size(F.array_distinct("_w")),
        _upper=count("[A-Z]+"), _digits=count("[0-9]+"), _marks=count("[!?]+"),
    ).drop("_t", "_w", "_lines", "_sorted", "_maybe", "_at")
    share = lambda a, b: F.round(F.coalesce(a / F.when(b > 0, b), F.lit(0.0)), 6)
    n, c = F.col("n_words"), F.col("word_chars")
    return df.withColumns({
        "mean_word_chars": share(c, n), "symbol_share": share(F.col("n_symbols"), c),
        "dup_line_share": share(F.col("n_dup_lines"), F.col("_lines_n")), "repeat_share": share(F.col("n_repeat_words"), n),
        "distinct_share": share(F.col("_distinct"), n), "upper_share": share(F.col("_upper"), c),
        "digit_share": share(F.col("_digits"), c), "mark_share": share(F.col("_marks"), c),
        "words_per_line": share(n, F.col("_lines_n")),
    }).drop("_lines_n", "_distinct", "_upper", "_digits", "_marks")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    hits: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """``(text, bad, fold)`` of at most about ``max_rows`` labelled documents, chosen by a hash of the id.

    Rows without id or label are left out; a document with several labels counts as bad if any is 0.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg((F.min(target) == 0).alias("bad"))
    h = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    n = marks.count()
    marks = marks.where(F.pmod(h, F.lit(1_000_000)) < F.lit(int(min(1.0, max_rows / max(n, 1)) * 1_000_000)))
    marks = marks.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("prune")), F.lit(3)).cast("int"))
    # bounded by max_rows, so it can go to every task
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "bad", "fold")


def learn_rules(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = 20_000, max_rules: int = 8,
                max_conditions: int = 3, bins: int = 48, min_precision: float = 0.9, min_hits: int = 5) -> list[Rule]:
    """Decision list for ``target`` = 0, learned from a bounded sample of labelled rows.

    A rule is grown on two thirds of the rows by information gain, and pruned on the rest to the prefix with the best
    (hits - misses) / covered. A rule whose precision on the rest is below ``min_precision``, or that hits
    fewer than ``min_hits`` growing rows, ends the list. No labelled rows give no rules. Ties go to the
    earlier statistic and the lower threshold.
    """
    rows = Stored(text_statistics(labelled_sample(docs, labels, target, max_rows)).select("bad", "fold", *FEATURES),
                  {"n": F.count(F.lit(1)), "hits": F.sum(F.col("bad").cast("long"))})
    try:
        if not rows.measures["n"] or not rows.measures["hits"]:
            return []
        marks = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
        quantiles = [F.percentile_approx(F.when(c, F.col(f).cast("double")), marks, 10_000).alias(f"{f}_{k}")
                     for f in FEATURES for k, c in enumerate((F.lit(True), F.col("bad")))]
        at = rows.table.agg(*quantiles).first()
        # thresholds lie half way between neighbouring quantiles of all rows and of the bad ones
        grid = {}
        for f in FEATURES:
            values = sorted({*at[f"{f}_0"], *at[f"{f}_1"]})
            grid[f] = [(x + y) / 2 for x, y in zip(values, values[1:])]
        found: list[Rule] = []
        left = rows.table
        while len(found) < max_rules:
            rule = _pruned(left, _grown(left, grid, max_conditions), min_precision, min_hits)
            if rule is None:
                break
            found.append(rule)
            left = left.where(~rule.column())
        return found
    finally:
        rows.drop()


def _cuts_below(feature: str, cut: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cut)), lambda c: c < F.col(feature)))


def _grown(left: DataFrame, grid: dict[str, list[float]], max_conditions: int) -> list[Condition]:
    conditions: list[Condition] = []
    rows = left.where("fold <> 0")
    while len(conditions) < max_conditions:
        # number of cut points below the value; a threshold splits between two bins
        at = F.array(*[_cuts_below(f, cut) for f, cut in grid.items()])
        counts = rows.select("bad", F.posexplode(at).alias("f", "b")).groupBy("f", "b").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("p")).collect()
        by = {i: sorted((r.b, r.n, r.p) for r in counts if r.f == i) for i in range(len(grid))}
        n_all, p_all = (sum(x[k] for x in by[0]) for k in (1, 2)) if by[0] else (0, 0)
        if not p_all or p_all == n_all:
            break
        best = None
        for i, (f, cut) in enumerate(grid.items()):
            n = p = 0
            steps = {b: (bn, bp) for b, bn, bp in by[i]}
            for b, c in enumerate(cut):
                n, p = n + steps.get(b, (0, 0))[0], p + steps.get(b, (0, 0))[1]
                for above, (cn, cp) in ((False, (n, p)), (True, (n_all - n, p_all - p))):
                    if cp and cn < n_all:
                        gain = cp * (log2(cp / cn) - log2(p_all / n_all))
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, Condition(f, above, c))
        if best is None or best[0] <= 1e-9:
            break
        conditions.append(best[1])
        rows = rows.where(best[1].column())
    return conditions


def _pruned(left: DataFrame, conditions: list[Condition], min_precision: float, min_hits: int) -> Rule | None:
    if not conditions:
        return None
    prefixes = [Rule(tuple(conditions[:k]), 0, 0) for k in range(1, len(conditions) + 1)]
    held, bad = F.col("fold") == 0, F.col("bad")
    sums = left.agg(*[F.count(F.when(c, 1)).alias(f"{n}{k}") for k, r in enumerate(prefixes) for n, c in (
        ("n", r.column() & held), ("p", r.column() & held & bad), ("gn", r.column() & ~held), ("gp", r.column() & ~held & bad))]).first()
    worth = lambda k: (2 * sums[f"p{k}"] - sums[f"n{k}"]) / sums[f"n{k}"] if sums[f"n{k}"] else -1.0
    k = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
    if sums[f"gp{k}"] < min_hits or not sums[f"n{k}"] or sums[f"p{k}"] < min_precision * sums[f"n{k}"]:
        return None
    return Rule(prefixes[k].conditions, sums[f"gn{k}"] + sums[f"n{k}"], sums[f"gp{k}"] + sums[f"p{k}"])


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, counted from 1, or null: one ordered conditional expression."""
    c = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(rules, 1))):
        c = F.when(r.column(), F.lit(k)).otherwise(c)
    return c


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the statistics, ``base_failed``, the number of the ``rule`` that holds (or null) and ``kept``.

    Null and empty texts have no words and fail. Repeated rows get the same verdict each. A column of ``docs`` with
    the name of a statistic is replaced.
    """
    df = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the base and the learned rules keep, with their own columns only."""
    rules = learn_rules(docs, labels, **options)
    packed = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judged(packed, rules).where("kept").select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
