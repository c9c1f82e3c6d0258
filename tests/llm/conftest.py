"""Tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with our own."""

import pytest

CLASHING = ["n", "fp", "key", "keys", "row_key", "kept_key", "size", "shard", "slot", "tokens", "domain", "epoch", "score", "predicted", "_scored", "_coded", "id", "cell", "rank", "label_", "h", "payload"]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bend"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source) as documents with clashing columns."""
    full = [(*r, *(("en", "src1") if len(r) == 2 else ()), len(r[1]) if r[1] is not None else None, *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def messy_rows():
    long = " ".join(f"word{i % 977} token{i % 31}" for i in range(30_000))
    return [
        (1, PROSE), (2, PROSE + " today"), (3, PROSE), (3, PROSE), (4, ""), (5, None), (6, "   \n\t "), (7, "two words"), (8, "Two WORDS"),
        (9, long), (10, long + " end"), (None, PROSE), (None, None), (11, "naïve café — “quoted” Ünïcode \U0001f600 tail"), (12, "tabs\tand\nlines\r\nand  spaces  "),
        (13, "<|endoftext|> special <|endoftext|>x"), (14, "a" * 5000), (15, PROSE.upper()),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return documents(spark, messy_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
