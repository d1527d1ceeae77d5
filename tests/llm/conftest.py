import pytest

pytest.importorskip("tidemark.llm")

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "same text here"), (5, "same text here"), (None, "no id at all"), (None, None),
    (6, "word " * 30_000), (7, "x" * 200_000), (8, "Ünïcödé 漢字 🙂 \x01\x02"),
]

#: Names of extra columns: those that operators use inside, and one with a dot.
CLASHING = ["label", "score", "_h", "_id", "_hash", "_text", "_drop", "_spans", "_n", "_fp", "_e", "_p", "node", "h", "n", "key", "a.b", "text_hash"]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns whose names operators use inside."""
    rows = [(i, t, "en", None, None if t is None else len(t), *range(len(CLASHING))) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING))


@pytest.fixture
def none(odd):
    return odd.where("false")
