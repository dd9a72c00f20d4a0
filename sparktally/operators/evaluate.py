"""Offline evaluation: accuracy, macro-F1, confusion, coverage, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktally import constants as K
from sparktally.operators.cumulative import is_number, running_totals, weighted_count

#: 26 thresholds from 0.40 to 0.90.
TAU_GRID = [0.4 + i * 0.02 for i in range(25)] + [0.9]


def _share(condition: Column) -> Column:
    """Mean of a condition over all rows, 0.0 on no rows."""
    return F.coalesce(weighted_count(condition) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(_share(F.col(truth).eqNullSafe(F.col(pred))).alias("accuracy"))


def pair_counts(df: DataFrame, truth: str, pred: str, *more: Column) -> DataFrame:
    """Rows per (truth, pred): the only full pass the class metrics need."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), *more
    )


def class_scores(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn and F1 of every class in truth or prediction.

    Further counts of ``pairs`` named in ``carry`` are summed over the rows that
    truly belong to the class.
    """
    n = F.col("n")
    none = F.lit(0).cast("bigint")

    def part(cls: str, tp: Column, fp: Column, fn: Column, own: bool) -> Column:
        kept = [(F.col(c) if own else none).alias(c) for c in carry]
        return F.struct(F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), *kept)

    hit = F.array(part("truth", n, none, none, True))
    miss = F.array(part("truth", none, none, n, True), part("pred", none, n, none, False))
    parts = pairs.select(F.inline(F.when(F.col("truth").eqNullSafe(F.col("pred")), hit).otherwise(miss)))
    sums = parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", *carry)])
    f1 = 2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return sums.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return class_scores(pair_counts(df, truth, pred)).agg(
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")
    )


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts of every truth and prediction class, empty cells included; they add up to the rows.

    As in the other class metrics a missing label is a class of its own. The grid is made from the class list of the already counted pairs, so its
    size is the square of the number of classes, whatever the number of rows.
    """
    pairs = pair_counts(df, truth, pred)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("c")), F.struct(F.col("pred").alias("c")))).alias("s"))
    classes = sides.agg(F.array_sort(F.collect_set("s")).alias("s"))  # in a struct null is kept
    grid = classes.select("s", F.explode("s").alias("t")).select(F.col("t.c").alias("truth"), F.explode("s").alias("p")).select(
        "truth", F.col("p.c").alias("pred"))
    counted = pairs.select(F.col("truth").alias("_t"), F.col("pred").alias("_p"), "n")
    same = F.col("truth").eqNullSafe(F.col("_t")) & F.col("pred").eqNullSafe(F.col("_p"))
    return grid.join(counted, same, "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def coverage_at(df: DataFrame, conf: str = "conf", tau: float = 0.6) -> DataFrame:
    covered = _share(F.col(conf) >= tau)
    return df.agg(covered.alias("coverage")).withColumn("fallback_rate", 1.0 - F.col("coverage"))


def eval_summary(df: DataFrame, truth: str, pred: str, conf: str, tau: float = 0.6) -> DataFrame:
    """One row: macro_f1, accuracy, coverage, fallback_rate, tau, classes; one pass over the rows."""
    pairs = pair_counts(df, truth, pred, weighted_count(F.col(conf) >= tau).alias("covered"))
    rows = F.sum(F.col("tp") + F.col("fn"))
    return class_scores(pairs, ("covered",)).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / rows).alias("accuracy_top1"),
        (F.sum("covered") / rows).alias("coverage_at_tau"),
        (1.0 - F.sum("covered") / rows).alias("fallback_rate"),
        F.lit(tau).alias("tau"),
        F.array_sort(F.collect_set(F.when(F.col("tp") + F.col("fn") > 0, F.col("class")))).alias("classes"),
    )


def tau_sweep(df: DataFrame, truth: str, pred: str, conf: str, grid: list[float] | None = None) -> DataFrame:
    """Coverage and macro-F1 for every threshold, from one pass over the rows."""
    grid = grid or TAU_GRID
    names = [f"_c{i}" for i in range(len(grid))]
    covered = [weighted_count(F.col(conf) >= tau).alias(name) for name, tau in zip(names, grid)]
    total = class_scores(pair_counts(df, truth, pred, *covered), tuple(names)).agg(
        F.avg("f1").alias("macro_f1"), F.sum(F.col("tp") + F.col("fn")).alias("_n"),
        *[F.sum(name).alias(name) for name in names],
    )
    points = F.array(*[
        F.struct(F.lit(tau).alias("tau"), (F.col(name) / F.col("_n")).alias("coverage"), "macro_f1")
        for name, tau in zip(names, grid)
    ])
    return total.select(F.inline(points))


def recommend_tau(sweep: DataFrame, target: float = 0.9, pick: str = "highest") -> DataFrame:
    """A threshold that still meets the coverage target.

    ``highest`` is the strictest such threshold, ``lowest`` the loosest one. If
    none meets the target, the one with the most coverage (the lowest on ties).
    """
    if pick not in ("highest", "lowest"):
        raise ValueError("pick is 'highest' or 'lowest'")
    chosen = (F.max if pick == "highest" else F.min)(F.when(F.col("coverage") >= target, F.col("tau")))
    best_covered = F.max_by("tau", F.struct("coverage", -F.col("tau")))
    points = F.collect_list(F.struct("tau", "coverage"))
    return sweep.agg(F.coalesce(chosen, best_covered).alias("tau"), points.alias("_p")).select(
        "tau", F.filter("_p", lambda p: p["tau"] == F.col("tau"))[0]["coverage"].alias("coverage")
    )


def qualitative_sample(df: DataFrame, key: str, conf: str, n: int = 12, seed: int = 7) -> DataFrame:
    """n rows drawn by a hash of the key, most confident first."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.orderBy(draw, key).limit(n).orderBy(F.desc(conf), key)


def percentile_summary(df: DataFrame, value: str, shares=(0.50, 0.95, 0.99)) -> DataFrame:
    """count, p50, p95, p99 at rank round-half-even(share * (n - 1)), and max; NaN counts as missing."""
    counts = df.where(is_number(value)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, value, ["n"])
    columns = [F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count")]
    for share in shares:
        rank = F.rint(F.lit(share) * (F.col("all_n") - 1))
        columns.append(
            F.min(F.when(F.col("cum_n") > rank, F.col(value))).alias(f"p{round(share * 100)}")
        )
    return ranked.agg(*columns, F.max(value).alias("max"))


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Rows at or below every bound and below infinity, with count and sum."""
    bounds = bounds or K.HISTOGRAM_BOUNDS
    v = F.col(value)
    total = df.agg(
        *[weighted_count(v <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("_n"),
        F.sum(v.cast("decimal(28,6)")).cast("double").alias("_sum"),
    )
    rows = [
        F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_b{i}").alias("count"), F.col("_sum").alias("sum"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("_n").alias("count"), F.col("_sum").alias("sum")))
    return total.select(F.inline(F.array(*rows)))


def quality_gates(metrics: DataFrame) -> DataFrame:
    """One boolean per gate whose metric is a column of the one-row ``metrics``."""
    checks = {
        f"{name}_ok": F.col(name) >= bound if side == "min" else F.col(name) <= bound
        for name, side, bound in K.QUALITY_GATES
        if name in metrics.columns
    }
    passed = metrics.withColumns(checks)
    every = F.lit(True)
    for name in checks:
        every = every & F.col(name)
    return passed.withColumn("all_ok", every)
