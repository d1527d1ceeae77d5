"""CSV tables that steps hand to each other, with their fallbacks, and text reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import FEATURE_LABELS
from tidemark.sources import store


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header. Types are taken from all of its values; names are lower case."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.toDF(*[c.lower() for c in df.columns])


def first_of(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The first of the tables that is there: cleaned readings before prepared ones."""
    tried = list(paths)
    for p in tried:
        if store.exists(spark, p):
            return read_csv(spark, p)
    raise FileNotFoundError(f"none of {tried}")


def optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A table, or None if it isn't there: without a health report no fly is removed by status."""
    return read_csv(spark, path) if path and store.exists(spark, path) else None


def loadings(spark: SparkSession, path: str) -> DataFrame:
    """(feature, loading): the sum of squared loadings over pc1 to pc8, of a table whose first column names features."""
    df = read_csv(spark, path)
    used = [c for c in (f"pc{i}" for i in range(1, 9)) if c in df.columns]
    if not used:
        raise ValueError(f"no columns pc1 to pc8 in {path}")
    return df.select(F.col(f"`{df.columns[0]}`").alias("feature"), sum((F.col(c) * F.col(c) for c in used[1:]), F.col(used[0]) * F.col(used[0])).alias("loading"))


def importances(spark: SparkSession, path: str) -> DataFrame:
    """(feature, importance, rank), largest first."""
    from pyspark.sql import Window

    df = read_csv(spark, path)
    if not {"feature", "importance"} <= set(df.columns):
        raise ValueError(f"{path} needs the columns feature and importance")
    return df.select("feature", "importance", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"))


def display_names(df: DataFrame, column: str = "feature") -> DataFrame:
    """``column`` as readers know it; names without a label stay."""
    labels = F.create_map(*[F.lit(v) for pair in FEATURE_LABELS.items() for v in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(labels, F.regexp_replace(column, "_z$", "")), F.col(column)))


def text_table(df: DataFrame, most: int = 1000) -> str:
    """A small result as aligned text, at most ``most`` rows."""
    rows = [df.columns, *[["" if v is None else f"{v:.10f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(most).collect()]]
    width = [max(len(r[i]) for r in rows) + 2 for i in range(len(df.columns))]
    return "\n".join("".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows) + "\n"


def report(sections: dict[str, DataFrame | str]) -> str:
    """Sections under their titles, in order."""
    return "\n".join(f"{title}\n{'-' * len(title)}\n{body if isinstance(body, str) else text_table(body)}" for title, body in sections.items())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file, by any path that Spark writes."""
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = out.getFileSystem(spark._jsc.hadoopConfiguration()).create(out, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
