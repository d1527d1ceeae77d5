"""PII: patterns for protected entities, and terms whose co-occurrence with an entity discloses it.

Base spans (email, ip, card, phone) come from patterns and their checks. They are the protected entities, known by kind and
value. Over the whole corpus, documents are counted that hold an entity (n_e), a term (n_t), and the term within ``window``
code points of the entity (n_te). The pointwise mutual information log(N n_te / (n_t n_e)) says how much of the entity's
information content log(N / n_e) the term gives away; where the share reaches ``disclosure`` and n_te reaches ``support``, every
place of the term becomes a span of kind term, in whatever text: who knows the term knows the entity, whether it stands beside
it or not. Terms are whole words of three characters or more that start with a letter. ``sanitise`` replaces spans by their
kind. Only built-in functions are used.

Null texts count as empty. Rows that repeat (doc_id, text) get equal results, and count as often as they occur. Places are
code points, end exclusive. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, column, having, unused

#: Marks the ends of matches; a text's own such characters are read as _OTHER, which no pattern matches either.
_MARK, _OTHER = "\u0001", "\u0002"
#: Possessive forms of the kinds' patterns; nothing that follows a possessive part could match within it.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
_HINT = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = list(PATTERNS)
TERM = r"(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{N}_]{2,}+"
BUCKETS = 1 << 20
#: Most disclosing terms that are sent along with a pass over the texts: a few MB.
MOST_TERMS = 1 << 16


def matches(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, value): the leftmost non-overlapping matches of the pattern, or those whose value is ``wanted``."""
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), empty.alias("out"))

    def step(s: Column, part: Column) -> Column:
        end = (s["at"] + F.char_length(part)).cast("int")
        one = F.array(F.struct(s["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~s["inside"]).alias("inside"), F.when(s["inside"] & wanted(part) if wanted else s["inside"], F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(F.split(marked, _MARK, -1), start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits holds."""
    back = F.split(F.reverse(digits), "")

    def add(total: Column, i: Column) -> Column:
        d = F.get(back, i).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        small = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, value) by start, then kind; kind is the place in KINDS."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def of(k: int, kind: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_HINT[kind])
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        named = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(hint, named).otherwise(none)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near_terms(text: Column, base: Column, window: int) -> Column:
    """For each base span, an array of (start, end, term) within the window; terms that touch a base span are left out."""

    def terms(b: Column) -> Column:
        a = F.greatest(b["start"] - window, F.lit(0))
        left, right = F.substring(text, a + 1, b["start"] - a), F.substring(text, b["end"] + 1, F.lit(window))
        # a word cut off by the window's edge is no term
        lead = F.transform(F.filter(matches(left, TERM), lambda m: (m["start"] > 0) | (a == 0)), lambda m: F.struct((m["start"] + a).alias("start"), (m["end"] + a).alias("end"), F.lower(m["value"]).alias("term")))
        tail = F.transform(F.filter(matches(right, TERM), lambda m: m["end"] < window), lambda m: F.struct((m["start"] + b["end"]).alias("start"), (m["end"] + b["end"]).alias("end"), F.lower(m["value"]).alias("term")))
        free = lambda t: ~F.exists(base, lambda o: (o["start"] < t["end"]) & (o["end"] > t["start"]))
        return F.filter(F.concat(lead, tail), free)

    return F.transform(base, lambda b: F.struct(F.concat_ws(":", b["kind"].cast("string"), F.lower(b["value"])).alias("entity"), terms(b).alias("terms")))


def _words(text: str = "text") -> Column:
    """Distinct words of a text, lower case. Words are cut before they are lowered: a lower-case letter may hold a mark that no
    word holds."""
    return F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}_]+"), F.lower))


def disclosing_terms(docs: DataFrame, near: DataFrame, scratch: Scratch, disclosure: float, support: int) -> DataFrame:
    """(entity, term) whose co-occurrence gives away at least the share ``disclosure`` of the entity's information.

    ``near`` has a row for each document with entities: an array of (entity, terms near it). All numbers count documents, each as
    often as it occurs.
    """
    total = float(docs.count())
    terms = lambda n: F.transform(n["terms"], lambda t: t["term"])
    both = F.flatten(F.transform("near", lambda n: F.transform(terms(n), lambda t: F.struct(n["entity"].alias("entity"), t.alias("term")))))
    each = lambda column, name: near.select(F.explode(F.array_distinct(column)).alias(name))
    entities = each(F.transform("near", lambda n: n["entity"]), "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = each(both, "p").groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)

    def tells(n_t: Column) -> Column:
        whole = F.log2(F.lit(total) / F.col("n_e"))
        return (whole > 0) & (F.log2(F.lit(total) * F.col("n_te") / (n_t * F.col("n_e"))) >= disclosure * whole)

    # a term is in at least the documents that hold it near any entity: pairs that fail on that number fail on the whole corpus
    least = each(F.flatten(F.transform("near", terms)), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = scratch.keep(pairs.join(least, "term").join(entities, "entity").where(tells(F.col("n_near"))))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).alias("_b")
    wanted = F.broadcast(pairs.select(bucket).distinct())
    seen = docs.select(F.explode(_words()).alias("term")).withColumn("_b", bucket).join(wanted, "_b", "left_semi")
    held = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(pairs.select("term").distinct(), "term", "left_semi")
    joined = pairs.join(held, "term")
    return scratch.keep(joined.where(tells(F.greatest("n_t", "n_te"))).select("entity", "term"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _term_places(terms: Column) -> Column:
    """Array of spans of kind term: the places of ``terms`` in a text where no base span is; null without terms."""

    def places(terms: Column, base: Column) -> Column:
        at = F.filter(matches(F.col("text"), TERM, lambda v: F.array_contains(terms, F.lower(v))), lambda m: ~F.exists(base, lambda o: (o["start"] < m["end"]) & (o["end"] > m["start"])))
        return F.transform(at, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["end"].alias("end"), F.lit("").alias("value")))

    return _let(terms, lambda t: F.when(F.size(t) > 0, _let(base_spans(F.col("text")), lambda base: places(t, base))))


def _found_at_once(texts: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, text_hash, more) by one pass over the texts, for at most MOST_TERMS terms, which go along with their hashes' flags."""
    flags = bytearray(BUCKETS)
    for (b,) in telling.select(F.pmod("h", F.lit(BUCKETS))).collect():
        flags[b] = 1
    known = telling.agg(F.collect_list("term").alias("_terms")).select("_terms", F.lit(bytes(flags)).alias("_flags"), F.lit(1).alias("_one"))
    beside = texts.withColumn("_one", F.lit(1)).join(F.broadcast(known), "_one")
    marked = lambda w: F.substring("_flags", (F.pmod(F.xxhash64(w), F.lit(BUCKETS)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    held = _let(F.filter(_words(), marked), lambda few: F.when(F.size(few) > 0, F.array_intersect(few, "_terms")))
    return beside.select("doc_id", "text_hash", _term_places(held).alias("more"))


def _found_by_join(texts: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, text_hash, more) for any number of terms: words meet terms, and the texts that hold some are read again."""
    held = having(texts.select("doc_id", "text_hash", F.explode(_words()).alias("term")).withColumn("h", F.xxhash64("term")), telling.select("h").distinct(), "h")
    held = held.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("term").alias("_held"))
    joined = texts.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return joined.select("doc_id", "text_hash", _term_places(F.col("_held")).alias("more"))


def find_spans(docs: DataFrame, disclosure: float = 0.8, support: int = 3, window: int = 80) -> DataFrame:
    """(doc_id, text_hash, base, spans): base spans and all spans of each document, both by start and then kind."""
    scratch = Scratch(docs.sparkSession, "pii")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    near = F.when(F.size("base") > 0, _near_terms(F.col("text"), F.col("base"), window))
    found = scratch.keep(texts.withColumn("base", base_spans(F.col("text"))).select("doc_id", "text_hash", "base", near.alias("near")))
    telling = disclosing_terms(docs, found.where("near is not null").select("near"), scratch, disclosure, support).select("term").distinct()
    telling = scratch.keep(telling.withColumn("h", F.xxhash64("term")))
    more = _found_at_once(texts, telling) if telling.count() <= MOST_TERMS else _found_by_join(texts, telling)
    more = more.where(F.size("more") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    more = scratch.keep(more.dropDuplicates(["_id", "_hash"]))
    out = found.drop("near").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.select("doc_id", "text_hash", "base", spans.alias("spans"))


def report(docs: DataFrame, **settings) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(docs, **settings)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; of overlapping spans the first by start stays. All
    columns stay as they are but text; rows are matched by doc_id and text."""
    key, text_key, every = unused(docs, "id", "hash", "spans")
    found = find_spans(docs, **settings).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key), F.col("spans").alias(every))
    names, text = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")]), F.coalesce(F.col("text"), F.lit(""))

    def step(s: Column, x: Column) -> Column:
        take = x["start"] >= s["at"]
        grown = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["kind"]))
        return F.struct(F.when(take, x["end"]).otherwise(s["at"]).alias("at"), F.when(take, grown).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(every, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(text_key)), "left")
    new = F.when(F.col(every).isNull(), F.col("text")).otherwise(clean)
    return joined.select(*[new.alias("text") if c == "text" else column(c) for c in docs.columns])
