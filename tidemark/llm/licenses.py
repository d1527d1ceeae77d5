"""License scan: canonical digests of whole texts, hash-joined to the digests of known licences.

A canonical text has no case, no copyright lines, one spelling of words that licences spell in several ways, and blanks in
place of everything but letters and digits. Its SHA-256 is joined with the digests of a registry (license_id, text), whose
texts go through the same steps. Only built-in functions are used.

Null texts count as empty; an empty canonical text has no licence. If several registry entries share a digest the smallest
license_id is reported, so rows never multiply. Repeated rows each keep their row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.license_texts import NOTICES, TEXTS

#: Lines that only say who holds the copyright, and spellings that mean the same.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;-]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|by |\[|<)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
SPELLINGS = (
    ("licenc", "licens"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("per cent", "percent"), ("&", " and "), ("https:", "http:"),
)
#: A registry of at most so many rows is broadcast (a digest and an id each); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """The registry that ships with the package: (license_id, text)."""
    return spark.createDataFrame([*TEXTS.items(), *NOTICES.items()], "license_id string, text string")


def scan_licenses(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each document: doc_id, digest, license_id (null if the text is no known licence)."""
    known = registry.select(digest(F.col("text")).alias("digest"), "license_id", canonical(F.col("text")).alias("_c"))
    known = known.where((F.col("_c") != "") & F.col("license_id").isNotNull()).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    if registry.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select("doc_id", digest(F.col("text")).alias("digest")).join(known, "digest", "left").select("doc_id", "digest", "license_id")


def scan_sql() -> str:
    """The same in DuckDB's SQL over the view documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def steps(text: str) -> str:
        out = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        return f"trim(regexp_replace({out}, {quote(r'[^\p{L}\p{N}]+')}, ' ', 'g'))"

    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in [*TEXTS.items(), *NOTICES.items()])
    return f"""
        WITH known AS (SELECT sha256({steps("body")}) AS digest, min(license_id) AS license_id FROM (VALUES {rows}) AS t(license_id, body)
                       GROUP BY 1),
             docs AS (SELECT doc_id, sha256({steps("text")}) AS digest FROM documents)
        SELECT doc_id, docs.digest AS digest, license_id FROM docs LEFT JOIN known ON docs.digest = known.digest"""
