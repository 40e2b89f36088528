"""Evaluation of rankings and classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.storage import saved


def ir_metrics(ranked: DataFrame, relevant_in_ideal: int = 6) -> DataFrame:
    """(query_id, reciprocal_rank, p5, ndcg10) from (query_id, rank from 1, is_target, relevant)."""
    ideal = sum(1 / np.log2(i + 2) for i in range(min(10, relevant_in_ideal)))
    gain = F.when(F.col("relevant") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return ranked.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("is_target"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        (F.count_if(F.col("relevant") & (F.col("rank") <= 5)) / 5).alias("p5"),
        (F.sum(gain) / ideal).alias("ndcg10"),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(pairs: DataFrame) -> DataFrame:
    """One row (n, accuracy, precision, recall, f1, kappa) from (truth, predicted); the middle three are macro means."""
    cells = confusion(pairs)
    truth = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("t"))
    said = cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    right = cells.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("h"))
    by = truth.join(said, "label", "full_outer").join(right, "label", "left").fillna(0, ["t", "p", "h"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    by = by.withColumn("precision", ratio(F.col("h"), F.col("p"))).withColumn("recall", ratio(F.col("h"), F.col("t")))
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    one = by.agg(F.sum("t").alias("n"), F.sum("h").alias("hits"), F.sum(F.col("t") * F.col("p")).alias("chance"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    observed, expected = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return one.select("n", observed.alias("accuracy"), "precision", "recall", "f1", F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(0.0).alias("kappa"))


#: Distinct values that are drawn in one task.
BUCKET_VALUES = 1 << 16


def bootstrap_ci(values: DataFrame, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row (mean, low, high): percentile interval of the mean of column x.

    A sample is a multinomial draw over the distinct values, made in two steps: how many of it fall on each bucket of
    values, and how many on each value of a bucket. Both have a seed of their own for each sample, so buckets are drawn
    by different tasks, and none holds more than its bucket.
    """
    known = values.filter("x IS NOT NULL")
    counts = saved(known.groupBy("x").agg(F.count("*").alias("n")), "bootstrap")
    buckets = max(1, -(-counts.count() // BUCKET_VALUES))
    placed = counts.withColumn("bucket", F.pmod(F.xxhash64("x"), F.lit(buckets)).cast("int"))
    sizes = {r.bucket: int(r.n) for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row a bucket
    shares = np.array([sizes.get(i, 0) for i in range(buckets)], float)
    n = int(shares.sum())

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        bucket, x, own = int(rows["bucket"].iloc[0]), rows["x"].to_numpy(float), rows["n"].to_numpy(float)
        sums = np.empty(samples)
        for i in range(samples):
            here = int(np.random.default_rng((seed, i)).multinomial(n, shares / n)[bucket])
            sums[i] = np.random.default_rng((seed, i, bucket)).multinomial(here, own / own.sum()) @ x
        return pd.DataFrame({"i": np.arange(samples), "s": sums})

    means = placed.groupBy("bucket").applyInPandas(draw, "i long, s double").groupBy("i").agg((F.sum("s") / F.lit(max(1, n))).alias("mean"))
    tail = (1 - level) / 2
    spread = means.agg(F.array_sort(F.collect_list("mean")).alias("m")).select(F.get("m", F.lit(int(samples * tail))).alias("low"), F.get("m", F.lit(int(samples * (1 - tail)) - 1)).alias("high"))  # `samples` values
    return known.agg(F.avg("x").alias("mean")).crossJoin(spread)


def permutation_test(differences: DataFrame, resamples: int = 10000, seed: int = 1, two_sided: bool = True) -> DataFrame:
    """One row (observed, p): sign-flip test on the mean of column x, with a slack of 1e-9.

    Of n differences of one size, those that keep their sign are a binomial draw, with a seed of its own for each size;
    so a task adds its sizes' draws for all resamples, and only sums by resample are shuffled.
    """
    known = differences.filter("x IS NOT NULL")
    sizes = known.groupBy(F.abs("x").alias("a")).agg(F.count("*").alias("n")).filter("a > 0")
    observed = known.agg(F.avg("x").alias("observed"), F.sum("x").alias("total"), F.count("*").alias("rows"))

    def flip(it):
        sums = np.zeros(resamples)
        for b in it:
            for a, n in zip(b["a"].to_numpy(float), b["n"], strict=True):
                rng = np.random.default_rng((seed, int(np.float64(a).view(np.uint64))))
                sums += a * (2.0 * rng.binomial(int(n), 0.5, resamples) - n)
        yield pd.DataFrame({"i": np.arange(resamples), "s": sums})

    sums = sizes.mapInPandas(flip, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    # without any difference every sum is zero
    sums = differences.sparkSession.range(resamples).select(F.col("id").alias("i")).join(sums, "i", "left").select(F.coalesce("s", F.lit(0.0)).alias("s"))
    beyond = F.abs("s") >= F.abs("total") - 1e-9 * F.col("rows") if two_sided else F.col("s") >= F.col("total") - 1e-9 * F.col("rows")
    hits = sums.crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count_if(beyond).alias("hits"))  # observed: one row
    return hits.select("observed", ((F.col("hits") + 1) / (resamples + 1)).alias("p"))


def precision_and_confidence(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(F.col("is_relevant").cast("double")).alias("precision"), F.avg("confidence").alias("confidence"))
