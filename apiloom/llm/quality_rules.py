"""Quality rules as a learned decision list.

Statistics of every whole text come from one vectorised pass. Sequential covering then learns from labelled rows: each
rule is grown on two thirds of them, one threshold condition at a time by information gain, and pruned from its end on
the last third; rows that it covers leave, and the next rule is grown. The list becomes one ordered Spark conditional
expression: the first rule that holds rejects the row, and a row that no rule rejects is kept.

The classifier is fitted on at most `max_labelled` labelled rows (default 20,000, the smallest hashes of the id), whose
few statistics go to the driver. Nothing else is bounded.

Defined results: a null or blank text has zero words and fails the base rule; repeated rows and null ids keep a row each;
a labelled id with several labels counts as its best, one with several texts as the one of the least ratios; with no labels the list is empty and only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import BLANKS, documents, in_batches, set_aside, slices

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "top_word_ratio"]
#: What the rules may test: ratios only, so that a long text is not judged by its length.
FEATURES = RATIOS


def text_statistics(text: str | None) -> tuple:
    """Counts and ratios of one whole text, in the order of COUNTS + RATIOS."""
    if not text:
        return (0,) * len(COUNTS) + (0.0,) * len(RATIOS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    repeated = distinct = top = 0
    if n:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        distinct, top = len(seen), int(np.bincount(ids).max())
        if n >= 3:
            _, pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
            _, triple, times = np.unique(pair * distinct + ids[2:], return_inverse=True, return_counts=True)
            twice = times[triple] > 1
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= twice
            repeated = int(covered.sum())
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    dup_lines = len(lines) - len(set(lines))
    raw = np.frombuffer(data, np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    d = max(1, n)
    ratios = (chars / d, symbols / d, dup_lines / max(1, len(lines)), repeated / d, upper / max(1, chars), digits / max(1, chars), top / d)
    return (n, chars, symbols, dup_lines, repeated, *ratios)


def with_statistics(docs: DataFrame, *, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """The rows with COUNTS (long) and RATIOS (double) of the text; columns of these names are replaced."""
    rows = docs.drop(*COUNTS, *RATIOS)
    kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATIOS)
    kept = [f for f in rows.schema if not (drop_text and f.name == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            stats = zip(*map(text_statistics, batch.column(text_col).to_pylist()), strict=True)
            columns = [batch.column(f.name) for f in kept] + [pa.array(s, k) for s, k in zip(stats, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + COUNTS + RATIOS)

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS]
    return in_batches(rows, run, ", ".join(declared))


Rule = list[tuple[str, str, float]]


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, value in rule:
        column = x[:, FEATURES.index(name)]
        out &= column > value if op == ">" else column <= value
    return out


def _grow(x: np.ndarray, bad: np.ndarray, conditions: list, depth: int) -> Rule:
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < depth and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        if not p:
            break
        before, best, best_gain = np.log2(p / (p + n)), None, 1e-9
        for condition in conditions:
            hit = inside & _holds(x, [condition])
            p1, n1 = (bad & hit).sum(), (~bad & hit).sum()
            if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - before)) > best_gain:
                best, best_gain = condition, gain
        if best is None:
            break
        rule.append(best)
        inside &= _holds(x, [best])
    return rule


def learn_decision_list(
    rows: np.ndarray, reject: np.ndarray, *, max_rules: int = 12, depth: int = 4, cuts: int = 24, precision: float = 0.97, support: int = 3
) -> list[Rule]:
    """Ordered rules, each a conjunction of (feature, > or <=, threshold), from rows of FEATURES and their labels.

    A rule stays when, on the rows held out for pruning and on those it was grown on, at least `precision` of the rows
    it covers are rejects and it covers `support` of them; the first that fails ends the list.
    """
    rules: list[Rule] = []
    third = np.arange(len(rows)) % 3 == 2
    left = np.ones(len(rows), bool)
    conditions = []
    for j, name in enumerate(FEATURES):
        values = np.unique(rows[:, j]) if len(rows) else np.empty(0)
        points = np.unique(np.quantile(values, np.linspace(0, 1, cuts + 1), method="lower")) if len(values) > 1 else []
        middle = [float((v + values[np.searchsorted(values, v, "right")]) / 2) for v in points if v < values[-1]]
        conditions += [(name, op, v) for v in middle for op in (">", "<=")]
    while len(rules) < max_rules and (reject & left).sum() >= support:
        grow, prune = left & ~third, left & third
        rule = _grow(rows[grow], reject[grow], conditions, depth)
        if not rule:
            break

        def worth(r: Rule, where: np.ndarray = prune) -> float:
            hit = _holds(rows, r) & where
            p, n = (reject & hit).sum(), (~reject & hit).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _holds(rows, rule) & left
        good = (reject & hit).sum()
        if good < support or good < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rule_text(rule: Rule) -> str:
    return " and ".join(f"{name} {op} {value:.6g}" for name, op, value in rule)


def rule_condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, op, value in rule:
        out = out & (F.col(name) > F.lit(value) if op == ">" else F.col(name) <= F.lit(value))
    return out


def decision(rules: list[Rule]) -> Column:
    """The text of the first rule that holds, else null: an ordered conditional expression."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule_condition(rule), F.lit(rule_text(rule))).otherwise(out)
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> list[Rule]:
    """Learn the list from at most `max_labelled` labelled rows; label 0 is a reject."""
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(max_labelled)
    )
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")
    stats = with_statistics(known, text_col="__text", drop_text=True)
    one = stats.groupBy("__id", "__label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("__id", "__label", "x.*")
    got = one.toPandas().sort_values("__id").reset_index(drop=True)
    order = np.random.default_rng(0).permutation(len(got))
    return learn_decision_list(got[FEATURES].to_numpy(float)[order], (got["__label"] == 0).to_numpy()[order])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_quality(docs: DataFrame, rules: list[Rule], *, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """The rows with statistics, `base_failed`, `rule` (the learned rule that rejects, else null) and `kept`."""
    out = with_statistics(docs, text_col=text_col, drop_text=drop_text).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The kept rows with exactly their own columns, whatever these are called."""
    moved, back = set_aside(docs, [*COUNTS, *RATIOS, "base_failed", "rule", "kept"])
    return back(judge_quality(moved, rules, text_col=text_col).where("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and the verdict on every document."""
    docs = documents(spark, sf_dir)
    rules = fit_rules(docs, documents(spark, sf_dir, "labels"))
    return judge_quality(docs.select("doc_id", "text"), rules, drop_text=True).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
