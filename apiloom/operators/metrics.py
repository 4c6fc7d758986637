"""Predictions against references: correctness, classification, text overlap, errors and data-set quality."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were"]


def classification_metrics(rows: DataFrame, *, positive: str | None = None, keys: tuple[str, ...] = ("prompt_id",)) -> DataFrame:
    """Accuracy and precision, recall, F1 of each key: of the positive class, or the mean over the reference classes.

    Counts come from one grouping by (key, expected, predicted); the class totals are sums of those few rows.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    cell = rows.groupBy(*keys, clean("expected").alias("expected"), clean("predicted").alias("predicted")).count()
    hit = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("count")).otherwise(0))
    total = cell.groupBy(*keys).agg((hit / F.sum("count")).alias("accuracy"))
    gold = cell.groupBy(*keys, F.col("expected").alias("cls")).agg(F.sum("count").alias("gold"), hit.alias("tp"))
    said = cell.groupBy(*keys, F.col("predicted").alias("cls")).agg(F.sum("count").alias("said"))
    per = gold.join(said, [*keys, "cls"], "left").fillna(0, ["said"])
    if positive is not None:
        per = per.where(F.col("cls") == positive)
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("tp") / F.col("gold")).otherwise(0.0)
    per = per.withColumn("p", p).withColumn("r", r).withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    means = per.groupBy(*keys).agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    return total.withColumn("accuracy", F.round("accuracy", 6)).join(means, list(keys), "left")


def counter_f1(rows: DataFrame) -> DataFrame:
    """Multiset overlap of predictions and references as precision, recall and F1."""
    said = rows.groupBy(F.col("predicted").alias("x")).agg(F.count("*").alias("a"))
    gold = rows.groupBy(F.col("expected").alias("x")).agg(F.count("*").alias("b"))
    sums = said.join(gold, "x", "full").fillna(0).agg(F.sum(F.least("a", "b")).alias("o"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    p, r = F.col("o") / F.col("a"), F.col("o") / F.col("b")
    return sums.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def words(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(text), "[ \t\n\x0b\f\r]+"), lambda w: w != "")


def error_patterns(rows: DataFrame) -> DataFrame:
    """Each prompt's confusions (expected, predicted, errors), and whether it is the most frequent of its expected class."""
    wrong = rows.where("expected != predicted").groupBy("prompt_id", "expected", "predicted").agg(F.count("*").alias("errors"))
    rank = F.row_number().over(Window.partitionBy("prompt_id", "expected").orderBy(F.desc("errors"), "predicted"))
    return wrong.withColumn("top", (rank == 1) & (F.col("errors") > 1))


def error_input_stats(rows: DataFrame) -> DataFrame:
    n = F.char_length("input")
    return rows.where("expected != predicted").groupBy("prompt_id").agg(F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def top_words(rows: DataFrame, *, key: str, text: str, k: int = 10) -> DataFrame:
    """The k most frequent words of each key (ties by word)."""
    return _most_frequent(rows.select(key, F.explode(words(F.col(text))).alias("word")), key, k)


def keywords(rows: DataFrame, *, key: str, text: str, k: int = 10) -> DataFrame:
    """The k most frequent words of each key that are no stop words (ties by word), without punctuation at their ends."""
    word = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return _most_frequent(rows.select(key, F.explode(F.transform(word, lambda w: F.trim(w, F.lit(".,!?;:")))).alias("word")), key, k)


def _most_frequent(each: DataFrame, key: str, k: int) -> DataFrame:
    count = each.groupBy(key, "word").agg(F.count("*").alias("n"))
    return count.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k)


def compare_prompts(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Error rates of two prompts over the inputs, and how many inputs only one or both got wrong."""
    side = lambda p, n: rows.where(F.col("prompt_id") == p).groupBy("input_id").agg(F.max((F.col("expected") != F.col("predicted")).cast("int")).alias(n))
    both = side(first, "e1").join(side(second, "e2"), "input_id", "full")
    out = both.agg(
        F.round(F.avg("e1"), 6).alias("error_rate_1"),
        F.round(F.avg("e2"), 6).alias("error_rate_2"),
        F.count_if((F.coalesce("e1", F.lit(0)) == 1) & (F.coalesce("e2", F.lit(0)) == 0)).alias("only_1"),
        F.count_if((F.coalesce("e1", F.lit(0)) == 0) & (F.coalesce("e2", F.lit(0)) == 1)).alias("only_2"),
        F.count_if((F.col("e1") == 1) & (F.col("e2") == 1)).alias("both"),
    )
    return out.withColumn("winner", F.when(F.col("error_rate_1") < F.col("error_rate_2"), first).when(F.col("error_rate_2") < F.col("error_rate_1"), second).otherwise("tie"))


def dataset_quality(samples: DataFrame) -> DataFrame:
    """Size, mean lengths, distinct outputs, blank rows and a score: the mean of size, diversity and completeness."""
    blank = (F.trim("input") == "") | (F.trim("output") == "")
    got = samples.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.char_length("input")), 6).alias("avg_input"),
        F.round(F.avg(F.char_length("output")), 6).alias("avg_output"),
        F.countDistinct("output").alias("distinct_outputs"),
        F.count_if(blank).alias("blank_rows"),
    )
    n = F.greatest(F.col("n"), F.lit(1))
    score = (F.least(F.col("n") / 50, F.lit(1.0)) + F.col("distinct_outputs") / n + (1 - F.col("blank_rows") / n)) / 3
    return got.withColumn("score", F.round(F.when(F.col("n") > 0, score).otherwise(0.0), 6))


def distribution_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """How alike two sample sets are: mean lengths, output shares and diversity, and the mean of the three."""
    stat = lambda df, s: df.agg(F.avg(F.char_length("input")).alias(f"l{s}"), (F.countDistinct("output") / F.count("*")).alias(f"d{s}"))
    share = lambda df, s: df.groupBy("output").count().withColumn(f"p{s}", F.col("count") / F.sum("count").over(Window.partitionBy())).select("output", f"p{s}")
    gap = share(left, 1).join(share(right, 2), "output", "full").fillna(0.0).agg((1 - F.sum(F.abs(F.col("p1") - F.col("p2"))) / 2).alias("outputs"))
    one = stat(left, 1).join(F.broadcast(stat(right, 2))).join(F.broadcast(gap))  # one row each
    ratio = lambda a, b: F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)
    out = one.select(F.round(ratio("l1", "l2"), 6).alias("lengths"), F.round("outputs", 6).alias("outputs"), F.round(ratio("d1", "d2"), 6).alias("diversity"))
    return out.withColumn("similarity", F.round((F.col("lengths") + F.col("outputs") + F.col("diversity")) / 3, 5))


def robustness_score(tests: DataFrame, baseline: float) -> DataFrame:
    """Mean accuracy of each perturbation, and the mean of those means over the baseline."""
    kinds = tests.groupBy("kind").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return kinds.withColumn("robustness", F.round(F.avg("accuracy").over(Window.partitionBy()) / baseline, 6)).withColumn("accuracy", F.round("accuracy", 6))


def prompt_length_stats(rows: DataFrame, *, key: str, text: str) -> DataFrame:
    n = F.size(words(F.col(text)))
    return rows.groupBy(key).agg(F.round(F.avg(n), 6).alias("mean_words"), F.round(F.stddev_pop(n), 6).alias("std_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def prompt_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over all distinct words."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*[tokens[i:] for i in range(n)], strict=False))


def bleu_score(reference: str, hypothesis: str, top: int = 4) -> float:
    """Clipped n-gram precision with a brevity penalty; orders longer than the hypothesis are not counted."""
    ref, hyp = (reference or "").lower().split(), (hypothesis or "").lower().split()
    logs = []
    for n in range(1, top + 1):
        mine = _grams(hyp, n)
        if not mine:
            break
        theirs = _grams(ref, n)
        shared = sum(min(c, theirs[g]) for g, c in mine.items())
        if not shared:
            return 0.0
        logs.append(np.log(shared / sum(mine.values())))
    if not logs:
        return 0.0
    return float(min(1.0, np.exp(1 - len(ref) / len(hyp))) * np.exp(np.mean(logs)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one row of the table at a time, vectorised over the other text."""
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a], np.int64)
    y = np.array([ids.setdefault(w, len(ids)) for w in b], np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        grown = np.where(y == w, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(grown, row[1:]))
    return int(row[-1])


ROUGE = [f"rouge_{n}{part}" for n in ("1", "2", "l") for part in ("", "_precision", "_recall")]


def rouge_scores(reference: str, hypothesis: str) -> tuple[float, ...]:
    """F1, precision and recall of shared words, of shared word pairs and of the longest common subsequence."""
    ref, hyp = (reference or "").lower().split(), (hypothesis or "").lower().split()

    def scores(shared: int, n: int, m: int) -> tuple[float, float, float]:
        return (2 * shared / (n + m), shared / m, shared / n) if shared else (0.0, 0.0, 0.0)

    out: tuple[float, ...] = ()
    for n in (1, 2):
        a, b = _grams(ref, n), _grams(hyp, n)
        out += scores(sum(min(c, b[g]) for g, c in a.items()), sum(a.values()), sum(b.values()))
    return out + scores(lcs_length(ref, hyp), len(ref), len(hyp))


def bleu(reference: str, hypothesis: str) -> Column:
    @F.pandas_udf("double")
    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bleu_score(x, y) for x, y in zip(r, h, strict=True)])

    return run(reference, hypothesis)


def rouge(reference: str, hypothesis: str) -> Column:
    @F.pandas_udf(", ".join(f"{c} double" for c in ROUGE))
    def run(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rouge_scores(x, y) for x, y in zip(r, h, strict=True)], columns=ROUGE)

    return run(reference, hypothesis)


def perturb(rows: DataFrame, *, id_col: str, text_col: str, seed: int = 0) -> DataFrame:
    """(id, kind, variant): each text in several disturbed forms. Choices come from MD5 of (seed, id, what is chosen),
    so they repeat: a typo swaps two letters next to each other in one word of three or more."""
    t = F.col(text_col)
    n = F.char_length(t)
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long")
    parts = F.filter(F.split(t, r"[ \t-\r]+"), lambda w: w != "")
    place = F.pmod(draw("word"), F.greatest(F.size(parts), F.lit(1))).cast("int")
    word = F.coalesce(F.get(parts, place), F.lit(""))
    at = F.pmod(draw("letter"), F.greatest(F.char_length(word) - 1, F.lit(1))).cast("int") + 1
    swapped = F.concat(F.substr(word, F.lit(1), at - 1), F.substr(word, at + 1, F.lit(1)), F.substr(word, at, F.lit(1)), F.substr(word, at + 2))
    swap = F.array_join(F.transform(parts, lambda w, i: F.when((i == place) & (F.char_length(w) > 2), swapped).otherwise(w)), " ")
    kinds = {
        "typo": F.when(F.size(parts) > 1, swap).otherwise(t),
        "spaces": F.replace(t, F.lit(" "), F.lit("  ")),
        "punctuation": F.concat(t, F.lit("!!!")),
        "half": F.substr(t, F.lit(1), F.floor(n / 2).cast("int")),
        "suffix": F.concat(t, F.lit(" please answer")),
        "upper": F.upper(t),
        "lower": F.lower(t),
        "prefix": F.concat(F.lit("Ignore this line. "), t),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("variant")) for k, v in kinds.items()]))
    return rows.select(id_col, each.alias("v")).select(id_col, "v.kind", "v.variant")
