"""What the corpus operators share: tables, written intermediate results, and labelled samples."""

from __future__ import annotations

import tempfile
import unicodedata
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder by HELD_OUT_MOD are never learned from.
HELD_OUT_MOD, HELD_OUT_IS = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and one machine does
    all the work. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("tidemark.scratch.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.scratch.dir", found)
    return found.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name for each of ``names`` that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def column(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def has_unassigned(word: str) -> bool:
    """Whether a word holds a code point that Python's Unicode tables don't assign: other tables may know it as a letter."""
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


#: Most rows and bytes of an Arrow batch that goes to Python: texts are long, and a worker holds some batches at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


#: Parquet's settings for wide rows: groups of 8 MB as packed, measured after every row, and of 8 rows at most.
WIDE_ROWS = {"parquet.block.row.count.limit": 8, "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


class Scratch:
    """Written intermediate results of one call of an operator.

    ``keep`` writes a frame as Parquet into the shared folder and reads it back, which cuts its lineage so that a lost
    executor costs only the tasks it held. ``drop`` deletes what no later frame reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, wide: bool = False) -> DataFrame:
        """``wide``: rows of a megabyte and more. Parquet else looks at the size of a row group after every hundred rows only, and
        writer and reader hold a whole group."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").options(**(WIDE_ROWS if wide else {})).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


#: Most keys of a broadcast table that ``having`` makes: 32 MB of numbers.
BROADCAST_KEYS = 1 << 22


def having(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose number ``on`` is one of ``keys``, a kept table of distinct numbers: broadcast if it has at most BROADCAST_KEYS,
    joined by shuffle beyond that."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def held_out(doc_id: Column) -> Column:
    """True where the row belongs to the part that no model learns from; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % HELD_OUT_MOD) == HELD_OUT_IS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, label) of at most ``bound`` labelled documents that aren't held out.

    The sample is the ``bound`` smallest hashes of doc_id, so it is the same on every run. Labels other than 0 and 1,
    null ids and ids with contradicting labels are left out. The ids are broadcast: ``bound`` rows of 12 bytes.
    """
    bound_batches(docs.sparkSession)
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_hi"))
        .where(F.col("label") == F.col("_hi"))
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sampled_features(sample: DataFrame, features: Column, most: int) -> list:
    """Rows (label, features), one for each sampled id, collected: at most as many as the sample's bound, and at most ``most``
    features in all. Rows with over a hundredth of that are left out; the others are taken in the sample's order of hashes."""
    found = sample.select("doc_id", "label", F.xxhash64("text").alias("_h"), features.alias("features"))
    one = found.groupBy("doc_id").agg(F.min_by("label", "_h").alias("label"), F.min_by("features", "_h").alias("features"))
    one = Scratch(sample.sparkSession, "sample").keep(one.where(F.size("features") <= most // 100))
    so_far = F.sum(F.size("features")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    few = one.select("doc_id", so_far.alias("n")).where(F.col("n") <= most).select("doc_id")
    return one.join(F.broadcast(few), "doc_id", "left_semi").orderBy("doc_id").select("label", "features").toArrow()
