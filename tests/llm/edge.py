"""Documents with every awkward case, and helpers that the tests share."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, key string, node string, sig string, shard string, curve string, p string, d string, rid string, _rid string, words string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def documents(spark, rows):
    """rows (doc_id, text, lang); further columns clash with names that the operators use inside."""
    full = [(i, t, g, None if i is None else f"src{i % 3}", None if t is None else len(t), *["x"] * 11) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, "   \n\t ", "en"),
        (5, LONG, "la"),
        (None, "a row without an identifier but with words enough to count", "en"),
        (6, "same text twice", "en"),
        (7, "same text twice", None),
        (7, "same text twice", None),
        (8, "1234 !!! ???", "en"),
        (9, "naïve café 日本語テスト \U0001f600 é", None),
        (10, "x" * 5000, "en"),
        (11, "<|endoftext|> it's 12 o'clock", "en"),
    ]
