"""Group comparisons over long tables (feature, group, value): ranks, tests, effect sizes, false discovery control.

Statistics are aggregates and windows within a feature, and tails of distributions are expressions; Python is left for Shapiro-Wilk
and for counting out small rank sums, on one row for each result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import native, tails


def to_long(features: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, feature, value) without missing values."""
    wide = features.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(ids, columns, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def mid_ranks(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Ranks within keys, ties at their mean, and the number of tied values."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn("ties", ties).withColumn("mid_rank", F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.col("ties") - 1) / 2.0)


def rank_table(long: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """(keys, value, g, n, ties, mid_rank): how often each group has each value, how often all groups together, and the rank
    that ties share. Equal values are counted where they are before any are sorted."""
    counts = long.groupBy(*keys, "value", group.alias("g")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rangeBetween(Window.unboundedPreceding, 0))
    ties = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rangeBetween(0, 0))
    return counts.withColumn("ties", ties).withColumn("mid_rank", upto - (F.col("ties") - 1) / 2.0)


def anova(long: DataFrame, group: str) -> DataFrame:
    """F, p and eta squared for each feature with at least two groups."""
    each = long.groupBy("feature", group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("v"))
    one = each.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    ssb = F.col("q") - F.col("n") * F.col("g") * F.col("g")
    one = one.where("k >= 2 and n > k").withColumn("ssb", F.greatest(ssb, F.lit(0.0)))
    one = one.withColumn("f", F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))))
    p = native.f_p(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return one.select("feature", "k", "n", "f", p.alias("p_value"), F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta_squared"))


def kruskal(long: DataFrame, group: str) -> DataFrame:
    """H corrected for ties, p and epsilon squared for each feature; null where all values are equal."""
    ranked = rank_table(long, ["feature"], F.col(group))
    each = ranked.groupBy("feature", "g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mid_rank")).alias("r"), F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1)).alias("t"))
    one = each.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("t").alias("t")).where("k >= 2")
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)
    one = one.withColumn("h", F.try_divide(raw, 1 - F.col("t") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))))
    p = native.chi2_p(F.col("h"), (F.col("k") - 1).cast("double"))
    return one.select("feature", "k", F.col("n").cast("long").alias("n"), "h", p.alias("p_value"), F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("epsilon_squared"))


def _pairs(each: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Pairs of a feature's groups, smaller name first; both sides have one row for each group."""
    left = each.select("feature", F.col(group).alias("g1"), *[F.col(n).alias(f"{n}1") for n in names])
    right = each.select("feature", F.col(group).alias("g2"), *[F.col(n).alias(f"{n}2") for n in names])
    return left.join(right, "feature").where("g1 < g2")


def dunn(long: DataFrame, group: str) -> DataFrame:
    """Dunn's z and Bonferroni p for each feature and pair of groups."""
    ranked = rank_table(long, ["feature"], F.col(group)).withColumnRenamed("g", group)
    each = ranked.groupBy("feature", group).agg(F.sum("n").cast("double").alias("n"), (F.sum(F.col("n") * F.col("mid_rank")) / F.sum("n")).alias("r"), F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1)).alias("t"))
    w = Window.partitionBy("feature")
    each = each.withColumn("total", F.sum("n").over(w)).withColumn("tt", F.sum("t").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    two = _pairs(each, group, ["n", "r", "total", "tt", "k"])
    n = F.col("total1")
    var = (n * (n + 1) / 12 - F.col("tt1") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    z = F.try_divide(F.col("r1") - F.col("r2"), F.sqrt(var))
    p = F.least(F.lit(1.0), native.normal_p(F.col("z")) * F.col("k1") * (F.col("k1") - 1) / 2)
    return two.withColumn("z", z).select("feature", "g1", "g2", "z", p.alias("p_adj"))


def tukey(long: DataFrame, group: str) -> DataFrame:
    """Tukey-Kramer q and p for each feature and pair of groups."""
    each = long.groupBy("feature", group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feature")
    each = each.withColumn("df", F.sum("n").over(w) - F.count(F.lit(1)).over(w)).withColumn("k", F.count(F.lit(1)).over(w).cast("double"))
    each = each.withColumn("mse", F.try_divide(F.sum(F.col("n") * F.col("v")).over(w), F.col("df")))
    two = _pairs(each, group, ["n", "m", "df", "k", "mse"])
    q = F.try_divide(F.abs(F.col("m1") - F.col("m2")), F.sqrt(F.col("mse1") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))
    return two.withColumn("q", q).select("feature", "g1", "g2", "q", native.tukey_p(F.col("q"), F.col("k1"), F.col("df1")).alias("p_adj"))


def normality(long: DataFrame, group: str) -> DataFrame:
    """Shapiro-Wilk p for each feature and group; a group of over 5000 values counts as not normal without being gathered."""
    few = F.count(F.lit(1)).over(Window.partitionBy("feature", group)) <= 5000
    kept = long.withColumn("_few", few)
    each = kept.groupBy("feature", group).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("_few"), F.col("value"))).alias("v"))
    return each.select("feature", group, "n", tails.shapiro_p("v").alias("p_value"))


def compare_groups(long: DataFrame, group: str, alpha: float = 0.05) -> DataFrame:
    """One row for each feature: ANOVA where every group looks normal, else Kruskal-Wallis, with effect size and p_adj (BH)."""
    normal = normality(long, group).groupBy("feature").agg(F.min("p_value").alias("least")).select("feature", (F.col("least") >= alpha).alias("normal"))
    a = anova(long, group).select("feature", F.col("p_value").alias("pa"), F.col("eta_squared").alias("ea"))
    k = kruskal(long, group).select("feature", F.col("p_value").alias("pk"), F.col("epsilon_squared").alias("ek"))
    both = normal.join(a, "feature", "left").join(k, "feature", "left").where("pa is not null or pk is not null")
    use = F.col("normal") & F.col("pa").isNotNull()
    out = both.select("feature", F.when(use, "ANOVA").otherwise("Kruskal-Wallis").alias("test_used"), "normal", F.coalesce(F.when(use, F.col("pa")).otherwise(F.col("pk")), F.lit(1.0)).alias("p_value"), F.when(use, F.col("ea")).otherwise(F.col("ek")).alias("effect_size"))
    return benjamini_hochberg(out, [], "p_value", "feature")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """p_adj: p n / rank, made monotone from the largest down, at most 1. ``key`` breaks ties and is unique in a family.

    Families are small result tables; without family columns the table is one family.
    """
    names = [F.lit(0)] if not family else family
    up, down = Window.partitionBy(*names).orderBy(p, key), Window.partitionBy(*names).orderBy(F.desc(p), F.desc(key))
    n, rank = F.count(F.lit(1)).over(Window.partitionBy(*names)), F.row_number().over(up)
    raised = df.withColumn("_q", F.col(p) * n / rank)
    return raised.withColumn("p_adj", F.least(F.lit(1.0), F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0)))).drop("_q")


def mann_whitney(long: DataFrame, keys: list[str], side: Column, least: int = 3, exact: bool = True) -> DataFrame:
    """U of the rows where ``side`` holds, rank-biserial r and p for each keys.

    Without ties and with at most eight values on a side p is exact; else, and beyond MOST_SUMS values of U, it is the normal one,
    corrected for ties and continuity; without ``exact`` it always is. Groups of fewer than ``least`` values on a side are left out.
    """
    ranked, n = rank_table(long, keys, side), F.col("n")
    one = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col("g"), n)).cast("double").alias("n1"), F.sum(F.when(~F.col("g"), n)).cast("double").alias("n2"),
        F.sum(F.when(F.col("g"), n * F.col("mid_rank"))).alias("r1"), F.sum(n * (F.col("ties") * F.col("ties") - 1)).alias("t"),
    ).where((F.col("n1") >= least) & (F.col("n2") >= least))
    one = one.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("n", F.col("n1") + F.col("n2"))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("t") / (F.col("n") * (F.col("n") - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)), sd)
    r = 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1
    few = (F.col("t") == 0) & (F.least("n1", "n2") <= 8) & (F.col("n1") * F.col("n2") <= tails.MOST_SUMS)
    counted = tails.rank_sum_p(F.when(few, F.col("u")), F.col("n1"), F.col("n2")) if exact else F.lit(None).cast("double")
    return one.withColumn("z", z).select(*keys, F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), "u", r.alias("rank_biserial"), F.coalesce(counted, native.normal_p("z"), F.lit(1.0)).alias("p_value"))


def one_vs_rest(long: DataFrame, label: str) -> DataFrame:
    """U, r and p of each label's values against all others, for each feature: ranks are global, so nothing is joined."""
    ranked = rank_table(long, ["feature"], F.col(label)).withColumnRenamed("g", label)
    each = ranked.groupBy("feature", label).agg(F.sum("n").cast("double").alias("n1"), F.sum(F.col("n") * F.col("mid_rank")).alias("r1"), F.sum(F.col("n") * (F.col("ties") * F.col("ties") - 1)).alias("t"))
    w = Window.partitionBy("feature")
    each = each.withColumn("n", F.sum("n1").over(w)).withColumn("t", F.sum("t").over(w)).withColumn("n2", F.col("n") - F.col("n1")).where("n1 >= 3 and n2 >= 3")
    each = each.withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("t") / (F.col("n") * (F.col("n") - 1))))
    each = each.withColumn("z", F.try_divide(F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)), sd))
    r = 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1
    return each.select("feature", label, "u", r.alias("rank_biserial"), F.coalesce(native.normal_p("z"), F.lit(1.0)).alias("p_value"), F.when(r > 0, "elevated").otherwise("suppressed").alias("direction"))


def cliffs_delta(long: DataFrame, group: str) -> DataFrame:
    """Cliff's delta of each pair of groups, 2 U / (n m) - 1, and its band.

    A value is one row with its count in every group; running sums tell how many values of each group lie below. The U of
    all pairs are sums over these rows, so that no row is copied for a pair. Groups are a handful of labels.
    """
    labels = sorted(r[0] for r in long.select(group).distinct().collect() if r[0] is not None)
    size = range(len(labels))
    pairs = [(i, j) for i in size for j in size if i < j]
    if not pairs:
        return long.select("feature", F.col(group).alias("g1"), F.col(group).alias("g2"), F.lit(0.0).alias("delta"), F.lit("").alias("magnitude")).where("false")
    counts = long.groupBy("feature", "value").agg(*[F.count_if(F.col(group) == labels[i]).cast("double").alias(f"n{i}") for i in size])
    w = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumns({f"b{i}": F.coalesce(F.sum(f"n{i}").over(w), F.lit(0.0)) for i in size})
    sums = [F.sum(F.col(f"n{i}") * (F.col(f"b{j}") + F.col(f"n{j}") / 2)).alias(f"u{i}_{j}") for i, j in pairs]
    one = below.groupBy("feature").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in size], *sums)
    each = F.array(*[F.struct(F.lit(labels[i]).alias("g1"), F.lit(labels[j]).alias("g2"), F.try_divide(2 * F.col(f"u{i}_{j}"), F.col(f"t{i}") * F.col(f"t{j}")).alias("share")) for i, j in pairs])
    out = one.select("feature", F.explode(each).alias("p")).select("feature", "p.g1", "p.g2", (F.col("p.share") - 1).alias("delta")).where("delta is not null")
    far = F.abs("delta")
    band = F.when(far < 0.147, "negligible").when(far < 0.33, "small").when(far < 0.474, "medium").otherwise("large")
    return out.withColumn("magnitude", band)


def cohens_d(long: DataFrame, label: str) -> DataFrame:
    """Cohen's d of each label against all others for each feature: moments of the rest are totals less the label's own."""
    each = long.groupBy("feature", label).agg(F.count(F.lit(1)).cast("double").alias("n1"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1"))
    w = Window.partitionBy("feature")
    each = each.withColumns({"n2": F.sum("n1").over(w) - F.col("n1"), "s2": F.sum("s1").over(w) - F.col("s1"), "q2": F.sum("q1").over(w) - F.col("q1")}).where("n1 >= 2 and n2 >= 2")
    ss = lambda i: F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col(f"n{i}")
    sd = F.sqrt(F.greatest(ss(1) + ss(2), F.lit(0.0)) / (F.col("n1") + F.col("n2") - 2))
    d = F.when(sd < 1e-12, 0.0).otherwise((F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")) / sd)
    return each.select("feature", label, d.alias("d"))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, expected, row_percent) for every combination of labels, also those that never occur together."""
    seen = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = seen.groupBy(row).agg(F.sum("n").alias("a")), seen.groupBy(col).agg(F.sum("n").alias("b"))
    total = seen.agg(F.sum("n").alias("total"))
    grid = rows.withColumn("_j", F.lit(1)).join(cols.withColumn("_j", F.lit(1)), "_j").drop("_j").join(F.broadcast(total))
    full = grid.join(seen, [row, col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(row, col, "n", (F.col("a") * F.col("b") / F.col("total")).alias("expected"), (F.col("n") * 100 / F.col("a")).alias("row_percent"))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """Chi-square of independence: chi2, df, p_value; Yates's correction for 2x2; no row if either side has one label."""
    cells = contingency(df, row, col)
    k = cells.agg(F.count_distinct(row).alias("r"), F.count_distinct(col).alias("c"))
    off = F.abs(F.col("n") - F.col("expected"))
    off = F.when((F.col("r") == 2) & (F.col("c") == 2), off - F.least(F.lit(0.5), off)).otherwise(off)
    one = cells.join(F.broadcast(k)).groupBy("r", "c").agg(F.sum(off * off / F.col("expected")).alias("chi2")).where("r >= 2 and c >= 2")
    one = one.withColumn("df", (F.col("r") - 1) * (F.col("c") - 1))
    return one.select("chi2", "df", native.chi2_p(F.col("chi2"), F.col("df").cast("double")).alias("p_value"))


def fisher(df: DataFrame, row: str, col: str) -> DataFrame:
    """Fisher's exact test of a two by two table: test, p_value; no row if either side hasn't exactly two labels."""
    cells = contingency(df, row, col)
    four = cells.agg(F.sort_array(F.collect_list(F.struct(row, col, "n"))).alias("c"), F.count_distinct(row).alias("r"), F.count_distinct(col).alias("k"))
    n = lambda i: F.get(F.col("c.n"), F.lit(i)).cast("long")
    return four.where("r = 2 and k = 2").select(F.lit("Fisher exact").alias("test"), native.fisher_p(n(0), n(1), n(2), n(3)).alias("p_value"))


def composition(df: DataFrame, row: str, col: str) -> DataFrame:
    """Whether a composition differs: test, p_value by Fisher's exact test for two by two labels, by chi-square otherwise."""
    chi = chi_square(df, row, col)
    small = chi.where("df > 1").select(F.concat(F.lit("Chi-square (df="), F.col("df"), F.lit(")")).alias("test"), "p_value")
    return fisher(df, row, col).unionByName(small)


def medians(long: DataFrame, label: str) -> DataFrame:
    """Median, interquartile range and number of values for each label and feature."""
    q = lambda p: F.percentile("value", F.lit(p))
    return long.groupBy(label, "feature").agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.count(F.lit(1)).alias("n"))
