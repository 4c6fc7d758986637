"""Ranking and selection: best of duplicates, top k, candidate selection, running values and rule resolution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiloom.session import cut


def best_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key under the order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """One relation for each (source, target): the strongest kind of evidence, the first seen of equals."""
    rank = F.when(F.col("type").startswith("LLM"), 3).when(F.col("type").startswith("FIELD"), 2).when(F.col("type").startswith("PATH"), 1).otherwise(0)
    return best_by(relations, ["source", "target"], [rank.desc(), "ord"])


def dedupe_dependencies(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the highest score, the first of equals."""
    return best_by(edges, ["src", "dst"], [F.desc("score"), "ord"])


def top_per_key(rows: DataFrame, key: str, score: str, k: int, tie: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def select_top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each run and iteration; of equal scores the later one comes first."""
    w = Window.partitionBy("run", "iteration").orderBy(F.desc("score"), F.desc("idx"))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ucb_select(candidates: DataFrame, k: int, c: float = 1.414) -> DataFrame:
    """Upper confidence bound of each prompt up to an iteration, and the k best of the iteration."""
    seen = Window.partitionBy("run", "prompt").orderBy("iteration", "idx").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(seen)
    ucb = F.avg("score").over(seen) + c * F.sqrt(F.ln(F.col("iteration") + 1) / n)
    scored = candidates.withColumn("ucb", F.round(ucb, 9))
    w = Window.partitionBy("run", "iteration").orderBy(F.desc("ucb"), F.desc("idx"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mmr_pick(rows: pd.DataFrame, k: int, weight: float) -> pd.DataFrame:
    """Greedy choice by weight * score + (1 - weight) * mean Jaccard distance to the chosen prompts."""
    rows = rows.sort_values(["score", "idx"], ascending=[False, True]).reset_index(drop=True)
    sets = [set(str(p).lower().split()) for p in rows["prompt"]]
    away = np.zeros(len(rows))
    left, chosen = list(range(len(rows))), []
    while left and len(chosen) < k:
        worth = [weight * rows["score"][i] + (1 - weight) * (away[i] / len(chosen) if chosen else 1.0) for i in left]
        pick = left.pop(int(np.argmax(worth)))
        chosen.append(pick)
        for i in left:
            union = len(sets[i] | sets[pick])
            away[i] += 1 - (len(sets[i] & sets[pick]) / union if union else 1.0)
    out = rows.loc[chosen, ["run", "iteration", "idx", "prompt", "score"]].copy()
    out["rank"] = range(1, len(out) + 1)
    return out


def diversity_select(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """MMR within each (run, iteration), as `mmr_pick` does for one: k rounds, in each of which every group takes its best
    candidate and the others add their distance to it. `idx` tells the candidates of a group apart."""
    group = ["run", "iteration"]
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("prompt", F.lit(""))), r"\s+"), lambda w: w != ""))
    left = cut(candidates.select(*group, "idx", "prompt", "score").withColumns({"words": words, "away": F.lit(0.0)}))
    out = None
    for rank in range(1, k + 1):
        apart = F.col("away") / (rank - 1) if rank > 1 else F.lit(1.0)
        best = F.max_by(F.struct("idx", "prompt", "score", "words"), F.struct(weight * F.col("score") + (1 - weight) * apart, "score", -F.col("idx"))).alias("best")
        pick = cut(left.groupBy(*group).agg(best))
        row = pick.select(*group, "best.idx", "best.prompt", "best.score", F.lit(rank).alias("rank"))
        out = row if out is None else out.unionByName(row)
        union = F.size(F.array_union("words", "best.words"))
        far = F.when(union > 0, 1 - F.size(F.array_intersect("words", "best.words")) / union).otherwise(0.0)
        left = cut(left.join(pick, group).where(F.col("idx") != F.col("best.idx")).withColumn("away", F.col("away") + far).drop("best"))
    return out


def ensemble_select(candidates: DataFrame, metrics: list[str], k: int) -> DataFrame:
    """Mean of min-max scaled metrics within an iteration (a constant metric stays as it is), k best."""
    w = Window.partitionBy("run", "iteration")
    scaled = []
    for m in metrics:
        low, high = F.min(m).over(w), F.max(m).over(w)
        scaled.append(F.when(high > low, (F.col(m) - low) / (high - low)).otherwise(F.col(m)))
    mean = sum(scaled[1:], scaled[0]) / len(scaled)
    rank = Window.partitionBy("run", "iteration").orderBy(F.desc("ensemble"), F.desc("idx"))
    return candidates.withColumn("ensemble", F.round(mean, 9)).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def adaptive_select(candidates: DataFrame, total: int, k: int) -> DataFrame:
    """By progress: diversity in the first 30 %, confidence bounds up to 70 %, then the plain top k."""
    progress = F.col("iteration") / F.lit(total)
    cols = ["run", "iteration", "idx", "prompt", "rank"]
    early = diversity_select(candidates.where(progress < 0.3), k).select(*cols, F.lit("diversity").alias("strategy"))
    ucb = ucb_select(candidates, k).where((progress >= 0.3) & (progress < 0.7)).select(*cols, F.lit("ucb").alias("strategy"))
    late = select_top_k(candidates.where(progress >= 0.7), k).select(*cols, F.lit("top_k").alias("strategy"))
    return early.unionByName(ucb).unionByName(late)


def early_stop_point(history: DataFrame, *, patience: int = 3, delta: float = 0.01) -> DataFrame:
    """Per run the first iteration with `patience` rounds in a row that do not beat the best by more than delta.

    The best moves only when it is beaten by more than delta, which no window maximum can say: a fold over the scores."""
    ordered = F.array_sort(F.collect_list(F.struct("iteration", "score")))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("int").alias("stop"))

    def step(acc, x):
        better = acc["best"].isNull() | (x["score"] > acc["best"] + delta)
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        stop = F.coalesce(acc["stop"], F.when(bad >= patience, x["iteration"]).cast("int"))
        return F.struct(F.when(better, x["score"]).otherwise(acc["best"]).alias("best"), bad.alias("bad"), stop.alias("stop"))

    return history.groupBy("run").agg(F.aggregate(ordered, start, step, lambda a: a["stop"]).alias("stop_at"))


def running_best(history: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.max("score").over(w)).withColumn("improvement", F.round(F.col("best") - F.first("score").over(w), 9))


def discounted_returns(steps: DataFrame, gamma: float = 0.9) -> DataFrame:
    """R_t = r_t + gamma R_(t+1), per episode: a fold from the end."""
    back = F.reverse(F.array_sort(F.collect_list(F.struct("t", "reward"))))
    fold = F.aggregate(
        back,
        F.struct(F.lit(0.0).alias("r"), F.array().cast("array<struct<t:bigint,ret:double>>").alias("out")),
        lambda a, x: F.struct(
            (x["reward"] + gamma * a["r"]).alias("r"),
            F.concat(a["out"], F.array(F.struct(x["t"].cast("bigint").alias("t"), (x["reward"] + gamma * a["r"]).alias("ret")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return steps.groupBy("episode").agg(fold.alias("out")).select("episode", F.inline("out"))


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation as `role: text` lines, oldest first."""
    last = messages.withColumn("__r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__r") <= n)
    line = F.concat_ws(": ", "role", "text")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("messages"))


def dedupe_samples(samples: DataFrame, floor: int = 5) -> DataFrame:
    return samples.where(F.char_length(F.trim("input")) >= floor).dropDuplicates(["input", "output"])


def sample_n(rows: DataFrame, n: int, *, id_col: str, seed: int = 0) -> DataFrame:
    """n rows by the smallest hash of (seed, id): a repeatable sample without replacement."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)


def filter_against_examples(samples: DataFrame, examples: DataFrame) -> DataFrame:
    """Samples of 5 to 500 characters whose input is not one of the examples."""
    n = F.char_length("input")
    return samples.where((F.trim("input") != "") & n.between(5, 500)).join(examples.select("input").distinct(), "input", "left_anti")


def quota_fill(rounds: DataFrame, threshold: float) -> DataFrame:
    """All rows of a round that scores the threshold or more, else its first floor(n * score) rows."""
    n = F.count("*").over(Window.partitionBy("round"))
    rank = F.row_number().over(Window.partitionBy("round").orderBy("idx"))
    quota = F.when(F.col("round_score") >= threshold, n).otherwise(F.floor(n * F.col("round_score")))
    return rounds.withColumn("__q", quota).withColumn("__r", rank).where("__r <= __q").drop("__q", "__r")


def resolve_rules(rules: DataFrame) -> DataFrame:
    """One rule for each type and pattern: the higher priority, the older one of equals; equal actions count once."""
    priority = 0.4 * F.col("value") + 0.4 * F.col("confidence") + 0.2 * F.col("age")
    return best_by(rules.withColumn("priority", F.round(priority, 9)), ["type", "pattern"], [F.desc("priority"), "ord"])


def applicable_rules(rules: DataFrame, params: dict[str, str]) -> DataFrame:
    """Rules none of whose conditions contradicts the parameters, most confident first within a type."""
    given = F.create_map(*[F.lit(x) for kv in params.items() for x in kv])
    fine = F.forall(F.map_entries("conditions"), lambda e: F.coalesce(given[e["key"]] == e["value"], F.lit(True)))
    return rules.where(fine).withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("confidence"), "ord")))


def best_parameters(trials: DataFrame) -> DataFrame:
    """Per task the best score with its parameters, the number of trials and the kind of rule it makes."""
    got = trials.groupBy("task_id").agg(F.max("score").alias("best_score"), F.max_by("params", F.struct("score", -F.col("ord"))).alias("params"), F.count("*").alias("trials"))
    return got.withColumn("rule_type", F.when(F.col("best_score") > 0.7, "success").otherwise("failure"))


def weighted_task_score(scores: DataFrame, weights: DataFrame) -> DataFrame:
    return scores.join(weights, "task").groupBy("prompt").agg(F.round(F.sum(F.col("score") * F.col("weight")), 6).alias("weighted"))
