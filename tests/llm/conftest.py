import pytest

#: Columns whose names the operators use themselves.
CLASHING = {"t": 1, "line": "x", "keys": 2, "kept": "no", "removed": 3, "n_words": "many", "host": None, "m": 4, "id": 5, "packed": "p", "spans": "s", "component_id": 6, "text_hash": "h", "n_tokens": 1.5}


@pytest.fixture
def documents(spark):
    """Maker of a documents table from (doc_id, text) or (doc_id, text, source) rows, with clashing extra columns."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        values = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(values, schema)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})
        return df

    return make


def sentence(seed: int, words: int = 40) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(words))


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, ties, a null id, a long text.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one two"),
    (5, sentence(5)),
    (5, sentence(5)),
    (6, sentence(5)),
    (7, None, None),
    (None, sentence(8)),
    (9, "é ß ￿ 漢字 " * 30 + "\x1c \x85 <|endoftext|>x"),
    (10, sentence(10, 30_000)),
    (11, "a" * 5000),
]
