"""Agreement, classification and distribution measures as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import maths, text


def paired(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows where both labels are given, normalised as a and b."""
    return df.select("*", text.label_form(a).alias("a"), text.label_form(b).alias("b")).where("a <> '' and b <> ''")


def confusion(pairs: DataFrame, keys: Sequence[str], positive: str) -> DataFrame:
    """Counts of a (truth) against b (guess) for one class, with the usual rates; null where undefined."""
    t, g = F.col("a") == positive, F.col("b") == positive
    c = pairs.groupBy(*keys).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & ~g).alias("tn"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    precision, recall = maths.share(F.col("tp"), F.col("tp") + F.col("fp")), maths.share(F.col("tp"), F.col("tp") + F.col("fn"))
    agree = maths.share(F.col("tp") + F.col("tn"), n)
    expected = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp"))) / (n * n)
    return c.select(*keys, "tp", "tn", "fp", "fn", precision.alias("precision"), recall.alias("recall"),
                    maths.share(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), agree.alias("accuracy"),
                    F.when(F.abs(1 - expected) > 1e-12, (agree - expected) / (1 - expected)).alias("kappa"), maths.share(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def collapsed(label: Column, kept: Sequence[str], merged: dict[str, str] | None = None, rest: str = "other") -> Column:
    """A label's class: those of ``kept`` stay or, if ``merged`` names them, become its class; all others are the rest."""
    form = text.label_form(label)
    out = F.when(~form.isin(*kept), rest)
    for value, name in (merged or {}).items():
        out = out.when(form == value, name)
    return out.otherwise(form)


def fdr_in_and_across(tests: DataFrame, family: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Adjusted p within each family (p_fdr_within) and over all tests (p_fdr_across)."""
    within = bh_adjusted(tests, family, p, tie).withColumnRenamed("p_fdr", "p_fdr_within")
    return bh_adjusted(within, [], p, [*family, *tie]).withColumnRenamed("p_fdr", "p_fdr_across")


def kappa(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, agreement, kappa) over all classes of a and b; kappa is null where chance agreement is complete."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    margins = cells.select(*keys, "n", F.explode(F.array(F.struct(F.lit("a").alias("s"), F.col("a").alias("v")), F.struct(F.lit("b").alias("s"), F.col("b").alias("v")))).alias("m")).groupBy(*keys, "m.v").agg(
        F.sum(F.when(F.col("m.s") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("m.s") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = margins.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    joined = total.join(chance, list(keys)) if keys else total.crossJoin(chance)
    e = F.col("x") / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", (F.col("same") / F.col("n")).alias("agreement"), F.when(F.abs(1 - e) > 1e-12, (F.col("same") / F.col("n") - e) / (1 - e)).alias("kappa"))


def bh_adjusted(tests: DataFrame, family: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p within a family; null p stays null and does not count."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, *tie)
    known = tests.where(F.col(p).isNotNull()).withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_q", F.col(p) * F.col("_n") / F.col("_r"))
    adjusted = known.withColumn("p_fdr", F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)))).drop("_r", "_n", "_q")
    return adjusted.unionByName(tests.where(F.col(p).isNull()).withColumn("p_fdr", F.lit(None).cast("double")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per key, ties at their average rank."""
    w = lambda c: Window.partitionBy(*keys).orderBy(c)
    same = lambda c: Window.partitionBy(*keys, c)
    rank = lambda c: F.rank().over(w(c)) + (F.count(F.lit(1)).over(same(c)) - 1) / 2.0
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def autocorrelation(panel: DataFrame, key: str, order: str, column: str, lags: int) -> DataFrame:
    """(key, lag, acf): correlation of a gap-free series with itself, pairs with a null left out."""
    w = Window.partitionBy(key).orderBy(order)
    shifted = panel.select(key, F.col(column).alias("y"), *[F.lag(column, k).over(w).alias(f"y{k}") for k in range(1, lags + 1)])
    each = shifted.groupBy(key).agg(*[F.corr("y", f"y{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    return each.select(key, F.posexplode(F.array(*[f"c{k}" for k in range(1, lags + 1)])).alias("p", "acf")).select(key, (F.col("p") + 1).alias("lag"), "acf")


def regime_shares(rows: DataFrame, regime: Column, labels: dict[str, Column], positive: str = "yes", unclear: str = "unclear") -> DataFrame:
    """(label, regime, n, positive_share, clear_share, unresolved_share): over all values, over clear ones, and the rest."""
    long = rows.select(regime.alias("regime"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), text.label_form(c).alias("v")) for n, c in labels.items()])).alias("l")).select("regime", "l.*")
    g = long.groupBy("label", "regime").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == positive).alias("yes"), F.count_if(~F.col("v").isin(unclear, "", "?")).alias("clear"))
    return g.select("label", "regime", "n", maths.share(F.col("yes"), F.col("n")).alias("positive_share"), maths.share(F.col("yes"), F.col("clear")).alias("clear_share"), maths.share(F.col("n") - F.col("clear"), F.col("n")).alias("unresolved_share"))


def divergence(rows: DataFrame, side: Column, value: Column, a: str, b: str) -> DataFrame:
    """One row: Jensen-Shannon distance (base 2) of a category's shares on two sides, and the largest change in points."""
    counts = rows.select(side.alias("s"), value.alias("v")).groupBy("v").agg(F.count_if(F.col("s") == a).alias("na"), F.count_if(F.col("s") == b).alias("nb"))
    every = Window.partitionBy()
    p = counts.select("v", (F.col("na") / F.sum("na").over(every)).alias("p"), (F.col("nb") / F.sum("nb").over(every)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0))
    return p.agg(F.sqrt(0.5 * part("p") + 0.5 * part("q")).alias("js_distance"), F.max(F.abs(F.col("p") - F.col("q")) * 100).alias("max_change_pp"))
