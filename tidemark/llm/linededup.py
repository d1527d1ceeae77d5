"""Line dedup: lines of all documents whose edit distance is at most ``edits`` (2), found by a segment-partition join.

A line is cut into edits + 1 segments. Of two lines within the distance at least one segment of the shorter stands
unchanged in the longer, at a place that the difference of lengths bounds; so segments are indexed under (length, number,
text) and every line probes the indexes of the lengths from its own down to its own less ``edits``. Candidates that hold
different letters, or whose finer pieces can't agree, are dropped; the rest, less what both have in common at their ends,
are verified by bit-parallel edit distance in a band of diagonals. Only built-in functions are used.

Keys go through one aggregation that drops those met by a single distinct line, or by no line of the indexed length, before
anything is joined; copies of a line collapse in it on the map side. Lines of at most ``edits`` code points have no segments:
they are all within the distance of each other, and longer lines find them by what both keep after deletions.

Lines are trimmed of blanks. Empty lines belong to no class and are kept. With ``per`` above 1 a link also needs ``per`` code
points of the longer line for each edit, so that short lines which merely look alike stay apart. A class is the component of
linked lines; its first line by (doc_id, line_no) is kept, null ids first.
Null texts count as one empty line. Rows that repeat (doc_id, text) are marked alike. Extra columns are ignored. Lines are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, column, having, unused
from tidemark.llm.components import component_labels

#: Most edits between linked lines, and code points of the longer line that there must be for each edit (1: any number).
EDITS, PER = 2, 1
#: Letters that are counted in lines which share a segment; two lines within the distance hold almost the same number of each.
LETTERS = "aeiotnsrhld"
#: Pieces of a candidate's shorter line; all but ``edits`` of them must stand in the longer one within ``edits`` places.
PIECES = 8


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line, h): every line of every document, trimmed; h is null for empty lines."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.trim("line")
    return lines.select("doc_id", "text_hash", "line_no", line.alias("line"), F.when(line != "", F.xxhash64(line)).alias("h"))


def segment_places(edits: int) -> list[tuple[int, int, int, int]]:
    """(role, d, i, shift): segment i of a line shorter by d, shifted. Role 0 is a line's own segment, 1 what it may hold."""
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                out.append((0 if d == shift == 0 else 1, d, i, shift))
    return out


def segment_keys(wide: DataFrame, edits: int) -> DataFrame:
    """(h, role, key) for each place of each line (h, wide, n).

    ``wide`` is the line in four bytes a code point, of which a segment is cut without a walk over what stands before it.
    The places are exploded first, so that the code for a key is compiled once and stays short.
    """
    places = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("role", "d", "i", "shift"), p, strict=True)]) for p in segment_places(edits)])
    rows = wide.select("h", "wide", "n", F.explode(places).alias("p")).select("h", "wide", "n", "p.*").withColumn("length", F.col("n") - F.col("d"))
    rows = rows.where(F.col("length") > edits)
    start, end = [F.floor(F.col("length") * (F.col("i") + k) / (edits + 1)).cast("int") for k in (0, 1)]
    rows = rows.withColumn("start", start + F.col("shift")).withColumn("size", end - start)
    rows = rows.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    return rows.select("h", "role", F.xxhash64("length", "i", F.substring("wide", 4 * F.col("start") + 1, 4 * F.col("size"))).alias("key"))


def bags(line: Column) -> list[Column]:
    """How often a line holds each of LETTERS, and all else. One edit changes the sum of differences by 2 at most."""
    n = F.char_length(line)
    each = [n - F.char_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    return [*[c.alias(f"c{i}") for i, c in enumerate(each)], (n - sum(each[1:], each[0])).alias(f"c{len(LETTERS)}")]


def common_ends(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, budget, s, t) with what s and t have in common at both ends cut off, found by halving steps. The distance stays."""
    steps = [1 << k for k in range(17, -1, -1)]
    out = pairs.withColumn("n", F.least(F.char_length("s"), F.char_length("t"))).withColumn("p", F.lit(0))
    for k in steps:
        same = (F.col("p") + k <= F.col("n")) & (F.substring("s", F.col("p") + 1, F.lit(k)) == F.substring("t", F.col("p") + 1, F.lit(k)))
        out = out.withColumn("p", F.when(same, F.col("p") + k).otherwise(F.col("p")))
    rest = lambda c: F.reverse(F.substring(c, F.col("p") + 1, F.char_length(c)))
    out = out.select("a", "b", "budget", rest("s").alias("s"), rest("t").alias("t"), (F.col("n") - F.col("p")).alias("n")).withColumn("p", F.lit(0))
    for k in steps:
        same = (F.col("p") + k <= F.col("n")) & (F.substring("s", F.col("p") + 1, F.lit(k)) == F.substring("t", F.col("p") + 1, F.lit(k)))
        out = out.withColumn("p", F.when(same, F.col("p") + k).otherwise(F.col("p")))
    return out.select("a", "b", "budget", *[F.reverse(F.substring(c, F.col("p") + 1, F.char_length(c))).alias(c) for c in ("s", "t")])


def pieces_agree(a: Column, b: Column, edits: int) -> Column:
    """Whether enough pieces of a, the shorter, stand in b near their places. True for every pair within the distance."""
    n, found = F.char_length(a), F.lit(0)
    for i in range(PIECES):
        start, end = F.floor(n * i / PIECES).cast("int"), F.floor(n * (i + 1) / PIECES).cast("int")
        near = F.greatest(start - edits, F.lit(0))
        found = found + F.contains(F.substring(b, near + 1, end + edits - near), F.substring(a, start + 1, end - start)).cast("int")
    return found >= PIECES - edits


def banded_distance(chars_a: Column, chars_b: Column, la: Column, lb: Column, edits: int) -> Column:
    """Edit distance of a and b (a not longer than b), or more than ``edits`` if it is more than ``edits``.

    Takes arrays of characters and their lengths, which have to be stored columns: the steps read them again and again.
    Bit k of a word stands for the diagonal k - edits of the band; a step takes one character of b. Vertical differences of
    +1 and -1 are two words, which move down one diagonal at each step, and the score follows the last cell of the band
    until the band meets the end of a, and then the end of a itself.
    """
    width = 2 * edits + 1
    word = lambda v: F.lit(v).cast("long")
    full, top = word((1 << width) - 1), word(1 << (width - 1))

    def bit(w: Column, k: Column) -> Column:
        spread = F.array(*[F.shiftrightunsigned(w, i).bitwiseAND(word(1)).cast("int") for i in range(width)])
        return F.when((k >= 0) & (k < width), F.get(spread, k)).otherwise(0)

    def step(s: Column, j: Column) -> Column:
        c, match = F.get(chars_b, j), word(0)
        for k in range(width):
            at = j + k - edits  # position in a
            match = match + F.when((at >= 0) & (at < la) & (F.get(chars_a, at) == c), word(1 << k)).otherwise(word(0))
        # transform over an array of one binds a value, so that it is computed once
        d0 = F.transform(F.array(match), lambda m: (m.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(m).bitwiseOR(s["vn"]).bitwiseAND(full))
        return F.get(F.transform(d0, lambda d: move(s, d, j)), F.lit(0))

    def move(s: Column, d0: Column, j: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"]))).bitwiseAND(full)
        hn, down, last = d0.bitwiseAND(s["vp"]), F.shiftrightunsigned(d0, 1), la - 1 - j + edits
        missed = (d0.bitwiseAND(top) == 0).cast("int")
        score = s["score"] + F.when(j + edits < la, missed).otherwise(bit(hp, last) - bit(hn, last))
        vp = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(full)
        return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), score.alias("score"))

    above = ((1 << (edits + 1)) - 1) << edits
    start = F.struct(word(above).alias("vp"), word(0).alias("vn"), F.lit(edits).alias("score"))
    return F.aggregate(F.sequence(F.lit(0), lb - 1), start, step, lambda s: s["score"])


def subsequence_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h, role, key) of lines of at most 2 * edits code points: what is left of them after at most ``edits`` deletions.

    A line of at most ``edits`` code points has an empty segment, which every line shares; so its longer partners are found by
    the letters that both keep. Role -1 is such a line, 1 a longer one. The empty rest is no key.
    """
    n = F.char_length("line")
    short = lines.where((n > 0) & (n <= 2 * edits)).select("h", n.alias("n"), F.split("line", "").alias("chars")).distinct()
    rows = short.select("h", "n", "chars", F.explode(F.array(*[F.lit(m) for m in range(1, 1 << 2 * edits)])).alias("mask"))
    rows = rows.where((F.col("mask") < F.expr("shiftleft(1, n)")) & (F.bit_count("mask") >= F.col("n") - edits))
    rest = F.array_join(F.expr("filter(chars, (c, i) -> shiftright(mask, i) & 1 = 1)"), "")
    return rows.select("h", F.when(F.col("n") <= edits, -1).otherwise(1).alias("role"), F.xxhash64(F.lit(-1), rest).alias("key")).distinct()


def line_links(lines: DataFrame, scratch: Scratch, edits: int = EDITS, per: int = PER) -> DataFrame:
    """(a, b): each pair of distinct lines (by h, a < b) of which the longer has ``n`` code points and whose edit distance is
    from 1 to the lesser of ``edits`` and n / per. Pairs of two lines of at most ``edits`` code points, which all link when per
    is 1, are left to the caller."""
    able = lines.where(F.char_length("line") >= max(per - edits, edits + 1)).select("h", "line")
    wide = able.select("h", F.encode("line", "UTF-32").alias("wide")).select("h", "wide", (F.octet_length("wide") / 4).cast("int").alias("n"))
    keys = segment_keys(wide, edits)
    if per == 1:
        able = lines.where("line <> ''").select("h", "line")
        keys = keys.unionByName(subsequence_keys(lines, edits))
    # a key counts if a line of its own length meets another line there
    met = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("role").alias("first"), F.max("role").alias("last"))
    shared = scratch.keep(met.where("lo < hi and first < 1 and last > -1").select("key"))
    met = scratch.keep(having(keys, shared, "key").distinct())
    scratch.drop(shared)
    # the texts of lines that share a key, and their bags of letters
    ends = scratch.keep(met.select("h").distinct())
    texts = scratch.keep(having(able, ends, "h").groupBy("h").agg(F.min("line").alias("line")))
    bag, names = texts.select("h", *bags(F.col("line"))), [f"c{i}" for i in range(len(LETTERS) + 1)]
    own = met.where("role < 1").select("key", F.col("h").alias("x")).join(bag.withColumnRenamed("h", "x"), "x")
    other = met.where("role > -1").select("key", F.col("h").alias("y"), "role").join(bag.select(F.col("h").alias("y"), *[F.col(c).alias(f"o{c}") for c in names]), "y")
    apart = sum((F.abs(F.col(c) - F.col(f"o{c}")) for c in names[1:]), F.abs(F.col(names[0]) - F.col(f"o{names[0]}")))
    fits = (F.col("x") != F.col("y")) & ((F.col("role") == 1) | (F.col("x") < F.col("y"))) & (apart <= 2 * edits)
    both = own.join(other, (own["key"] == other["key"]) & fits)
    pairs = scratch.keep(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    scratch.drop(met)
    left, right = texts.select(F.col("h").alias("a"), F.col("line").alias("ta")), texts.select(F.col("h").alias("b"), F.col("line").alias("tb"))
    read = pairs.join(left, "a").join(right, "b")
    longer = F.char_length("ta") > F.char_length("tb")
    read = read.select("a", "b", F.when(longer, F.col("tb")).otherwise(F.col("ta")).alias("s"), F.when(longer, F.col("ta")).otherwise(F.col("tb")).alias("t"))
    budget = F.least(F.lit(edits), F.floor(F.char_length("t") / per)).cast("int")
    read = read.withColumn("budget", budget).where(F.char_length("t") - F.char_length("s") <= F.col("budget"))
    middle = scratch.keep(common_ends(read))
    likely = middle.where((F.char_length("s") < 4 * PIECES) | pieces_agree(F.col("s"), F.col("t"), edits))
    # the band starts on as many characters as there may be edits: both get the same ones in front
    s, t = (F.concat(F.lit("\u0001" * edits), F.col(c)) for c in ("s", "t"))
    likely = scratch.keep(likely.select("a", "b", "budget", F.split(s, "").alias("s"), F.split(t, "").alias("t"), F.char_length(s).alias("ls"), F.char_length(t).alias("lt")))
    links = likely.where(banded_distance(F.col("s"), F.col("t"), F.col("ls"), F.col("lt"), edits) <= F.col("budget"))
    links = scratch.keep(links.select("a", "b"))
    for done in (pairs, texts, middle, likely):
        scratch.drop(done)
    return links


def _linked(lines: DataFrame, scratch: Scratch, edits: int, per: int) -> DataFrame:
    """(node, label, n_links) of every distinct line that links with another."""
    links = line_links(lines, scratch, edits, per)
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    if per > 1:
        return scratch.keep(component_labels(links, scratch).join(ends, "node"))
    # lines of at most ``edits`` code points are all within the distance: a star joins them, and each links with all but itself
    tiny = scratch.keep(lines.where((F.col("line") != "") & (F.char_length("line") <= edits)).select("h").distinct())
    row = tiny.agg(F.min("h"), F.count(F.lit(1))).first()
    least, count = (row[0] or 0), row[1]
    star = tiny.where(F.col("h") != least).select(F.lit(least).alias("a"), F.col("h").alias("b"))
    labels = component_labels(links.unionByName(star), scratch)
    degree = ends.unionByName(tiny.select(F.col("h").alias("node"), F.lit(count - 1).alias("n_links"))).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return scratch.keep(labels.join(degree, "node"))


def _marked(docs: DataFrame, edits: int, per: int) -> DataFrame:
    if per != 1 and per <= 2 * edits:
        raise ValueError("per is 1, or more than twice the edits")
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = document_lines(docs)
    linked = _linked(lines, scratch, edits, per)
    # one row for each distinct line: its class and first place
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "line_no", "text_hash")
    distinct = lines.where("h is not null").groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    named = distinct.join(linked, distinct.h == linked.node, "left")
    named = scratch.keep(named.select("h", F.coalesce("label", "h").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first", "n").where("n > 1 or n_links > 0"))
    first = named.groupBy("class_id").agg(F.min("first").alias("first"))
    odd = scratch.keep(named.drop("first").join(first, "class_id").select(F.col("h").alias("_h"), "class_id", "n_links", "first"))
    scratch.drop(named)
    scratch.drop(linked)
    out = lines.select("doc_id", "text_hash", "line_no", "h", place.alias("_p")).join(odd, F.col("h") == F.col("_h"), "left")
    kept = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("_p"))
    return out.select("doc_id", "text_hash", "line_no", F.coalesce("class_id", "h").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"))


def mark_lines(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """One row for each line of each document: doc_id, line_no (from 0), class_id, n_links, kept.

    class_id is the smallest line hash of the class (null for empty lines), n_links the number of distinct other texts that the
    line links with directly, kept is true for the first line of a class and for empty lines.
    """
    return _marked(docs, edits, per).drop("text_hash")


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, per: int = PER) -> DataFrame:
    """The documents without the lines that aren't kept; documents of which no text is left go. Columns stay as they are;
    n_chars, where there is one, is the new length. Null texts stay null and keep their row."""
    key, text_key, drop, new = unused(docs, "id", "hash", "drop", "text")
    dropped = _marked(docs, edits, per).where("not kept").groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).agg(F.collect_set("line_no").alias(drop))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(drop, i))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_key)), "left").withColumn(new, text)
    out = out.where(F.col(drop).isNull() | (F.trim(F.regexp_replace(new, r"\s+", " ")) != ""))
    columns = [F.col(new).alias("text") if c == "text" else F.when(F.col(drop).isNull(), F.col(c)).otherwise(F.char_length(new)).cast(t).alias(c) if c == "n_chars" else column(c) for c, t in docs.dtypes]
    return out.select(*columns)
