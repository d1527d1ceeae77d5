"""Near copies of five-word similarity 0.8 or more: SimHash and MinHash bands find pairs, exact sets of shingles decide them.

Fingerprints of ``simhash`` that differ in at most ``BUDGET`` bits are found by its tries, and the links of their forests are tried
first. Pairs of similarity 0.8 differ in some ten bits, beyond what tries find, so MinHash bands then suggest pairs between the
groups that are left.

A text is the set of its shingles of ``width`` words; texts with one set are one node. ``BANDS`` bands of ``ROWS`` minima each
deal the nodes into buckets: two sets of similarity 0.8 share none of them once in 20,000 times, more similar ones far more
seldom. Every suggested pair whose sizes allow it counts only if the Jaccard similarity of the whole sets reaches ``LEAST``. Groups
are components of such pairs.

Every node of a bucket is tried with one node of it, the hub, which differs from bucket to bucket, unless both are in one group
already. Buckets whose nodes are in one group by then are done. While the others hold many more pairs between groups than nodes,
they are tried with another hub; then all pairs of nodes that are not yet in one group are tried, each in the first bucket that it
shares. So a large group of copies costs about its size, no bucket is gathered in one place, and no pair that could join two groups
is left out.

Null texts count as empty, and texts without words are copies of each other. Repeated rows and null ids are rows like others.
Extra columns are kept.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import simhash
from tidemark.llm.common import Scratch, unused
from tidemark.llm.components import component_labels

LEAST, BANDS, ROWS = Fraction(4, 5), 25, 5
#: Bits by which fingerprints of a pair may differ; pairs for each node of open buckets beyond which another hub is tried, and hubs.
BUDGET, MANY_PAIRS, MOST_HUBS = 4, 2, 6
_FACTORS = np.random.default_rng(11).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PRIME, _CHUNK = np.uint64(0x9E3779B97F4A7C15), 1024


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, in order, of a whole text's shingles. Words are those of ``simhash.fingerprint``; fewer words
    than ``width`` are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, wide = max(len(words) - width + 1, 1), min(width, len(words))
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = out * _PRIME + h[i : i + n]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A signed key for each band of a set of shingle hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    low, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * low[None, at : at + _CHUNK]).min(axis=1), out=least)
    keys, sign = np.arange(1, BANDS + 1, dtype=np.uint64), least.reshape(BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = _mixed(keys * _PRIME + sign[:, j])
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both * LEAST.denominator >= (len(a) + len(b) - both) * LEAST.numerator


def _signed(width: int):
    @F.pandas_udf("fp long, node long, n int, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingles(t, width)
            out.append((simhash.fingerprint(t), np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64), len(s), band_keys(s)))
        return pd.DataFrame(out, columns=["fp", "node", "n", "bands"])

    return of


def _packed(width: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts], dtype=object)

    return of


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _compatible(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (node, n, other, m) whose sizes allow the similarity, each once."""
    fits = F.least("n", "m") * LEAST.denominator >= F.greatest("n", "m") * LEAST.numerator
    return pairs.where(fits).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").where(_alike("set_a", "set_b")).select("a", "b")


def _simhash_pairs(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, other, m) of nodes that SimHash links: a forest over fingerprints, and nodes of one fingerprint with one of them."""
    one = scratch.keep(prints.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("r")).select("fp", "r.node", "r.n"))
    links = simhash.fingerprint_links(one.select("fp"), scratch, BUDGET)
    first, other = one.withColumnRenamed("fp", "a"), one.select(F.col("fp").alias("b"), F.col("node").alias("other"), F.col("n").alias("m"))
    linked = links.join(first, "a").join(other, "b").select("node", "n", "other", "m")
    same = prints.select("fp", "node", "n").distinct().join(other.withColumnRenamed("b", "fp"), "fp").select("node", "n", "other", "m")
    return scratch.keep(linked.union(same).where("node != other"))


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """Verified pairs (a, b) of nodes, whose components are those of all of similarity LEAST or more among ``pairs`` and in buckets."""
    key, text_key = unused(docs, "id", "hash")
    keys = nodes.select("node", "n", "bands", F.explode("bands").alias("key"))
    shared = scratch.keep(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"))

    def apart(rows: DataFrame, near: DataFrame) -> DataFrame:
        """The rows of buckets that hold several groups, with their groups."""
        named = scratch.keep(rows.join(near, "node", "left").select("key", "node", "n", "bands", F.coalesce("label", "node").alias("label")))
        several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        rows = scratch.keep(named.join(several, "key"))
        scratch.drop(named)
        return rows

    members = scratch.keep(keys.join(shared, "key"))
    tried = members.select("node").union(pairs.select("node")).union(pairs.select("other")).distinct()
    wanted = tried.join(nodes, "node").select("node", F.col("least.doc_id").alias(key), F.col("least.text_hash").alias(text_key))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key))
    sets = scratch.keep(docs.select("doc_id", "text").join(wanted, same).select("node", _packed(width)("text").alias("set")).dropDuplicates(["node"]))
    near = component_labels(scratch.keep(_verified(_compatible(pairs), sets)), scratch)
    members = apart(members, near)
    for k in range(MOST_HUBS):
        hub = F.min(F.struct(F.xxhash64("key", "node", F.lit(k)).alias("by"), "node", "n", "label")).alias("hub")
        hubs = members.groupBy("key").agg(hub).select("key", F.col("hub.node").alias("other"), F.col("hub.n").alias("m"), F.col("hub.label").alias("beside"))
        met = _verified(_compatible(members.join(hubs, "key").where("label != beside")), sets)
        stars = near.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a < b")
        links = scratch.keep(stars.union(met))
        near = component_labels(links, scratch)
        members = apart(members.drop("label"), near)
        groups = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        size = groups.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
        if (size[1] or 0) <= MANY_PAIRS * (size[0] or 0):
            break
    mirror = members.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("label").alias("beside"), F.col("bands").alias("over"))
    # a pair meets in the first band that both have
    first = F.array_position(F.zip_with("bands", "over", lambda x, y: x == y), True) == F.array_position("bands", F.col("key"))
    rest = _verified(_compatible(members.join(mirror, "key").where(F.col("label") < F.col("beside")).where(first)), sets)
    links = scratch.keep(near.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a < b").union(rest))
    scratch.drop(sets)
    return links


def keep_one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The first document of each group of near copies, by doc_id and then hash of text; of rows that repeat it, one. All
    columns stay."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    key, text_key = unused(docs, "id", "hash")
    # known ids come before null ones
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    signed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _signed(width)("text").alias("s")).select("doc_id", "text_hash", "s.*")
    prints = scratch.keep(signed)
    nodes = scratch.keep(prints.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    pairs = _simhash_pairs(prints, scratch)
    scratch.drop(prints)
    labels = scratch.keep(component_labels(_links(docs, nodes, pairs, scratch, width), scratch).withColumnRenamed("node", "_n"))
    named = nodes.join(labels, nodes.node == labels["_n"], "left").select(F.coalesce("label", "node").alias("label"), "least")
    kept = named.groupBy("label").agg(F.min("least").alias("k")).select(F.col("k.doc_id").alias(key), F.col("k.text_hash").alias(text_key))
    kept = scratch.keep(kept)
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key))
    found = docs.join(kept, same, "left_semi")
    repeats = found.groupBy("doc_id", F.xxhash64("text").alias(text_key)).agg(F.count(F.lit(1)).alias(key)).where(F.col(key) > 1).limit(1).count()
    return found.dropDuplicates(["doc_id", "text"]) if repeats else found
