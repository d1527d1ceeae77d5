import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import decontam, licenses, linededup, pii


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, e in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
        p = q
    return p[-1]


def edited(base, most, letters="abcé"):
    out = list(base)
    for _ in range(random.randint(0, most)):
        r, p = random.random(), random.randrange(len(out))
        out[p : p + (r >= 1 / 3)] = [random.choice(letters)] if r < 2 / 3 else []
    return "".join(out)


def test_banded_distance(spark):
    random.seed(1)
    pairs = []
    for _ in range(300):
        a = "".join(random.choice("abé🙂") for _ in range(random.randint(3, 20)))
        a, b = sorted((a, edited(a, 4)), key=len)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.split("a", "").alias("x"), F.split("b", "").alias("y"), F.char_length("a").alias("n"), F.char_length("b").alias("m"))
    for edits in (1, 2, 3):
        got = df.where(f"m - n <= {edits} and n >= {edits}").withColumn("d", linededup.banded_distance(F.col("x"), F.col("y"), F.col("n"), F.col("m"), edits)).collect()
        for r in got:
            d = distance(r.a, r.b)
            assert r.d == d if d <= edits else r.d > edits, (r.a, r.b)


def test_lines_against_all_pairs(spark):
    random.seed(3)
    lines = []
    for _ in range(30):
        base = "".join(random.choice("abcdé ") for _ in range(random.randint(24, 60))).strip(" ")
        lines += [base, *(edited(base, 5) for _ in range(8))]
    # capitals that grow when lowered, lines of few code points, and lines shorter than the distance
    few = ["İstanbul İzmir en guzel sehirler olsun", "Astanbul Azmir en guzel sehirler olsun", "chapter one", "chapter on", "a", "b", "xy", "zé", "xyz", "qqq", "wxyz", "🙂🙂", "🙂x"]
    lines[9:9] = few + ["".join(random.choice("pqr") for _ in range(random.randint(1, 9))) for _ in range(32)]
    lines = lines[: 30 * 9]
    docs = [(i, "\n".join(lines[i * 9 : i * 9 + 9])) for i in range(30)] + [(100, None), (101, ""), (None, "short\nshort\n" + lines[0]), (102, lines[0] + "\n\n" + lines[5]), (102, "other " * 9)]
    got = linededup.mark_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    every = [(d, k, v.strip(" ")) for d, t in docs for k, v in enumerate((t or "").split("\n"))]
    assert len(got) == len(every)
    long = sorted({v for _, _, v in every if v})
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    degree = dict.fromkeys(long, 0)
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                root[find(a)] = find(b)
                degree[a] += 1
                degree[b] += 1
    texts = {}
    for d, k, v in every:
        texts.setdefault((d, k), set()).add(v)
    pairs = {(r.class_id, find(v)) for r in got for v in texts[r.doc_id, r.line_no] if len(texts[r.doc_id, r.line_no]) == 1 and v}
    assert len(pairs) == len({c for c, _ in pairs}) == len({v for _, v in pairs})
    assert all(r.n_links == degree.get(next(iter(texts[r.doc_id, r.line_no])), 0) for r in got if len(texts[r.doc_id, r.line_no]) == 1)
    ours = {(r.doc_id, r.line_no): r.class_id for r in got}
    assert ours[1, 0] == ours[1, 1] and degree[few[0]] >= 1 and degree["a"] >= 5
    kept = [r.class_id for r in got if r.kept and r.class_id is not None]
    assert len(kept) == len(set(kept)) == len({r.class_id for r in got} - {None})


def test_edits_in_proportion(spark):
    texts = ["abcdefghijk", "abcdefghijx", "abcdefghijkl", "abcdefghijkX", "ok", "no", "q" * 30, "q" * 28 + "zz", "q" * 27 + "zzz"]
    got = linededup.mark_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), per=12)
    # one edit for each 12 code points of the longer line
    want = {i: sum(a != b and distance(a, b) <= min(2, max(len(a), len(b)) // 12) for b in texts) for i, a in enumerate(texts)}
    assert {r.doc_id: r.n_links for r in got.collect()} == want and want[2] == 2 and want[4] == 0
    with pytest.raises(ValueError):
        linededup.mark_lines(spark.createDataFrame([(1, "x")], "doc_id long, text string"), per=3)


def test_large_family(spark):
    """A thousand lines of which every two are within two edits: each links with all others, in one class."""
    base = "the committee met on the third of march and agreed nothing"
    family = {base[:i] + c + base[i + 1 :] for i in range(len(base)) for c in "abcdefghijklmnopqr"}
    got = linededup.mark_lines(spark.createDataFrame(list(enumerate(sorted(family))), "doc_id long, text string")).collect()
    assert len(family) > 900 and {r.n_links for r in got} == {len(family) - 1} and len({r.class_id for r in got}) == 1 and sum(r.kept for r in got) == 1


def test_repeated_lines_go(spark, odd, none):
    docs = spark.createDataFrame([(1, "a line that stands in both texts\nmine", 37), (2, "a line that stands in both texts.\nyours indeed", 46), (3, "a line that stands in both texts", 32), (4, None, None), (5, "", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.drop_repeated_lines(docs).collect()}
    assert got == {1: ("a line that stands in both texts\nmine", 37), 2: ("yours indeed", 12), 4: (None, None), 5: ("", 0)}
    assert linededup.mark_lines(odd).count() > 0 and linededup.drop_repeated_lines(odd).columns == odd.columns
    assert linededup.mark_lines(none).count() == 0 and linededup.drop_repeated_lines(none).count() == 0


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(text):
    def luhn(d):
        return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}.get(kind, lambda: True)()

    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    random.seed(5)
    texts = [None, "", "a@b.c_d@e.f", "\x01a@b.co\x01 1.2.3.4.5.6.7.8 \x02", "é🙂x+1@y.zz 4111 1111 1111 1111 +1 (724) 555-7058", "1" * 5000, "a" * 3000 + "@b", "1-" * 3000 + "1", "0001.2.3.0255 300.1.1.1 4111111111111111"]
    pieces = ["1", "2", "4", "0", ".", "-", " ", "@", "+", "a", "_", "é", "\x01", "(", ")", "🙂", "25", "4111111111111111", "x.y@z.w "]
    texts += ["".join(random.choice(pieces) for _ in range(random.randint(1, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("text", pii.spans_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect():
        assert r.s == spans(r.text), r.text


def test_disclosing_terms(spark, odd, none):
    rows = [(i, f"zebra{i % 3}word stands near bob.{i % 3}@mail.example.com today") for i in range(12)] + [(100 + i, "near today stands") for i in range(60)] + [(200, "far away, zebra0word " + "and so on " * 30 + "Zebra0word; zebra0words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert got[0].n_email == 1 and got[0].spans == "term:0:10,email:23:45"  # the telling word, not the common ones
    assert got[100].spans == ""
    assert got[200].spans == "term:10:20,term:321:331"  # the term tells wherever it stands, as a whole word
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "[TERM] stands near [EMAIL] today" and clean[100] == "near today stands"
    assert pii.report(odd).count() == odd.count() and pii.sanitise(odd).columns == odd.columns
    assert pii.report(none).count() == 0


def test_licenses(spark, odd, none):
    known = licenses.known_licenses(spark)
    mit = licenses.TEXTS["MIT"].replace("<year> <copyright holders>", "2031 Somebody Else").upper().replace(",", " ,\n")
    docs = spark.createDataFrame([(1, mit), (2, mit + " more"), (3, "Licenced under the Apache Licence — Version 2.0"), (4, "© 2020 x\n")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {1: "MIT", 2: None, 3: "Apache-2.0 (notice)", 4: None}
    twice = known.unionByName(known.withColumn("license_id", F.concat(F.lit("z"), "license_id")))
    assert licenses.scan_licenses(odd, twice).count() == odd.count() and licenses.scan_licenses(none, known).count() == 0
    assert licenses.scan_licenses(docs, known.where("false")).where("license_id is not null").count() == 0


def test_licenses_by_file_and_title(spark):
    texts, rest = licenses.TEXTS, licenses.TEXTS["MIT (without title)"]
    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
    rows = [(n, texts[n].replace("\n", "\r\n\t").upper()) for n in names]
    rows += [("Apache-2.0 (without appendix)", texts["Apache-2.0"].split("APPENDIX")[0])]
    rows += [("MIT (The MIT License (MIT))", f"The MIT License (MIT)\n\nCopyright (c) 2019 A. Body\n\n{rest}")]
    rows += [("BSD-3-Clause (BSD 3-Clause License)", f"BSD 3-Clause License\n\nCopyright (c) 2020, B\nAll rights reserved.\n\n{texts['BSD-3-Clause']}")]
    rows += [("ISC (without title)", "Copyright (c) 2021 C\n\n" + texts["ISC"].removeprefix("ISC License\n\n")), ("none", texts["GPL-3.0"][:-400])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i] or "none" for i in range(len(rows))] == [n for n, _ in rows]


def lcs_slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y and x else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 90))
        assert decontam.lcs(a, b) == lcs_slow(a.tolist(), b.tolist())


def test_leaks(spark, odd, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    common = [word() for _ in range(30)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    items = [(i, text(rng.choice([16, 30, 50, 140])) + ". " + text(6) + ".") for i in range(12)] + [(99, None), (None, ""), (98, " ")]
    docs, want = [], {}
    for d in range(300):
        body = text(rng.randint(0, 300))
        if d % 6 == 0:
            k = d // 6 % 12
            passage = items[k][1].upper()
            if d % 12 == 0:  # a tenth of the words in other words
                passage = " ".join(word() if rng.random() < 0.1 else w for w in passage.split(" "))
            body, want[d] = f"{body} {passage} {text(rng.randint(0, 200))}", k
        docs.append((d, body))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()}
    assert got == set(want.items())
    left = decontam.drop_contaminated(df.withColumn("lang", F.lit("en")), bench)
    assert {r.doc_id for r in left.collect()} == set(range(300)) - set(want) and left.columns == ["doc_id", "text", "lang"]
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(df, bench.where("false")).count() == 0


@pytest.mark.parametrize(("replaced", "least"), [(0.0, 1.0), (0.3, 1.0), (0.5, 0.9)])
def test_paraphrases_in_running_text(spark, monkeypatch, replaced, least):
    """Items with a share of their words replaced and their answer kept, inside longer texts: found, and nothing else is."""
    monkeypatch.setattr(decontam, "_PIECES", 7)
    rng = random.Random(int(replaced * 10))
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(4000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.randint(14, 50)), some(rng.randint(4, 8))) for i in range(40)]
    docs, want = [(i, " ".join(some(rng.randint(60, 700)))) for i in range(150)], set()
    for i, question, answer in items:
        told = [w if rng.random() >= replaced else rng.choice(vocabulary) for w in question]
        around = some(rng.randint(50, 400))
        at = rng.randrange(len(around))
        docs.append((1000 + i, " ".join([*around[:at], *told, *answer, *around[at:]])))
        want.add((1000 + i, i))
    benchmark = spark.createDataFrame([(i, " ".join(q) + ". " + " ".join(a) + ".") for i, q, a in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got <= want and len(got) >= least * len(want)


def slow_report(rows, disclosure=0.8, support=3, window=80):
    """All spans of each text by loops over the documents."""
    word = regex.compile(r"(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{N}_]{2,}")
    texts = [t or "" for _, t in rows]
    base = [[(int(a), k, int(b)) for k, a, b in (s.split(":") for s in spans(t).split(",") if s)] for t in texts]
    pairs, entities, held = Counter(), Counter(), Counter()
    for t, spots in zip(texts, base, strict=True):
        held.update({w.lower() for w in regex.split(r"[^\p{L}\p{N}_]+", t)})
        near, seen = set(), set()
        for a, kind, b in spots:
            entity, lo = (kind, t[a:b].lower()), max(a - window, 0)
            seen.add(entity)
            found = [(m.start() + lo, m.end() + lo, m[0]) for m in word.finditer(t[lo:a]) if m.start() or not lo] + [(m.start() + b, m.end() + b, m[0]) for m in word.finditer(t[b : b + window]) if m.end() < window]
            near |= {(entity, w.lower()) for x, y, w in found if not any(p < y and q > x for p, _, q in spots)}
        pairs.update(near)
        entities.update(seen)
    n, telling = len(rows), set()
    for (e, w), k in pairs.items():
        whole = math.log2(n / entities[e])
        if k >= support and whole > 0 and math.log2(n * k / (max(held[w], k) * entities[e])) >= disclosure * whole:
            telling.add(w)
    out = []
    for t, spots in zip(texts, base, strict=True):
        more = [(m.start(), "term", m.end()) for m in word.finditer(t) if m[0].lower() in telling and not any(p < m.end() and q > m.start() for p, _, q in spots)]
        out.append(",".join(f"{k}:{a}:{b}" for a, k, b in sorted([*spots, *more], key=lambda s: (s[0], [*KINDS, "term"].index(s[1])))))
    return out, telling


@pytest.mark.parametrize("most", [1 << 16, 0])
def test_terms_equal_loops(spark, monkeypatch, most):
    """Repeated rows, null ids, capitals that lower to two signs, and terms found in one pass or by join."""
    monkeypatch.setattr(pii, "MOST_TERMS", most)
    rng = random.Random(3)
    names = ["ΟΔΟΣ", "café", "Straße", "q_1x", "ab", "9lives", "word", "near", "today", "İİİ"]
    people = ["eve@y.org", "bob@x.org", "+1 724 555 7058", "10.0.0.1"]
    rows = [(i % 40 or None, " ".join(rng.choice(names) if rng.random() < 0.8 else rng.choice(people) for _ in range(rng.randint(1, 14)))) for i in range(150)]
    rows += [(300 + i, "Zanzibar beside amy@y.org here") for i in range(6)] + [(400 + i, "met İstanbul near kim@z.org today") for i in range(5)] + [(500 + i, f"plain text {i} word near today here") for i in range(300)]
    rows += [(None, "Lagos and joe@w.org"), (None, "Lagos and joe@w.org"), (None, "so Lagos is joe@w.org"), (7, None), (8, ""), (9, "x " * 300 + "Zanzibar")]
    for some in (rows, rows * 3):
        got = Counter((r.doc_id, r.spans) for r in pii.report(spark.createDataFrame(some, "doc_id long, text string")).collect())
        want, telling = slow_report(some)
        assert got == Counter((i, s) for (i, _), s in zip(some, want, strict=True))
        assert {"zanzibar", "i̇stanbul", "lagos"} <= telling and "near" not in telling
