"""Small awkward tables shared by the tests, and brute-force twins."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x" for i in range(6000))
AWKWARD = [
    (1, "the same text here", "en", "a"), (2, "the  same\ttext here", "en", "a"), (2, "the  same\ttext here", "en", "a"), (3, None, "en", None),
    (4, "", None, "b"), (5, " \n\t ", "de", "b"), (None, "the same text here", None, "c"), (6, LONG, "en", "a"), (7, LONG + " tail", "fr", "a"),
    (8, "ünïcode ✓ 𝒳 text with the same words", "fr", "b"), (9, "x", "es", "é"), (10, LONG, "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ", _row string, _text string, _id long, fp long, kept boolean, `odd.name` int, _stay long, _hash long, _at string, _key string, _left double, _doc string"


def awkward(spark, extra: bool = True):
    """Null and repeated ids, null, empty and long texts, columns named like the operators' own."""
    if not extra:
        return spark.createDataFrame(AWKWARD, SCHEMA)
    return spark.createDataFrame([(*r, "r", "t", 99, 5, False, 1, 7, 8, "at", "k", 0.5, "d") for r in AWKWARD], SCHEMA + CLASHING)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
