"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text; a rule is a row (measure, lowest, highest)
of `RULES`, and the table becomes one Boolean column each. No shuffle, no user function.

Defined results: a null or empty text has no word, all counts 0, and fails the base rule (too short).
A null id stays null; repeated rows are judged one by one; an empty table gives an empty result; other
columns are never read. A text of any length is handled: repeated windows are found by sorting its
window hashes (64 bits; two different windows of one text are taken for equal with odds below n^2/2^65).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm.text import total, trimmed, word_list

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from", "not", "have", "but", "or", "an", "you",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "ein", "eine", "als", "auch", "es", "er",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "par", "dans", "qui", "avec", "pas", "sur", "au", "ce", "il", "ne",
    "el", "y", "los", "se", "las", "del", "por", "con", "no", "su", "para", "al", "lo", "como", "más", "o",
)

#: (rule, measure, lowest allowed, highest allowed); None: open. Measures are columns of `measured`.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_length", 2.5, 12.0),
    ("symbol_ratio", "symbol_ratio", None, 0.25),
    ("stop_word_ratio", "stop_ratio", 0.01, None),
    ("letter_word_ratio", "letter_ratio", 0.6, None),
    ("duplicate_line_ratio", "dup_line_ratio", None, 0.6),
    ("bullet_line_ratio", "bullet_ratio", None, 0.9),
    ("ellipsis_line_ratio", "ellipsis_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT_PCT = 50, 50


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Counts and ratios of every text. `keep`: further columns to carry."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    rows = rows.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumn("_joined", trimmed(F.col("_text")))
    rows = rows.withColumn("_words", word_list(F.col("_joined")))
    # lines with a word; a text without a line break has at most one, so no duplicate
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w, n = F.col("_words"), F.size("_words")
    rows = rows.withColumn("_hashes", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), n - 2)))
    # most texts repeat no window: a distinct count settles those without sorting
    h = F.col("_hashes")
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")
    again = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(F.filter(s, lambda x, k: again(x, k + 1) | again(x, k - 1)), lambda x: x["i"])))
    t = F.col("_starts")
    covered = F.coalesce(total(F.transform(t, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(t, k + 1) - x, F.lit(3))).cast("long"))), F.lit(0))
    n_lines = F.size("_lines").cast("long")
    rows = rows.select(
        "doc_id", *keep,
        n.cast("long").alias("n_words"),
        F.when(n == 0, 0).otherwise(F.char_length("_joined") - n + 1).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )
    ratio = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
    return rows.select(
        "*", ratio("word_chars", "n_words").alias("word_length"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_ratio"), ratio("n_letter_words", "n_words").alias("letter_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"), ratio("n_bullet_lines", "n_lines").alias("bullet_ratio"), ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_ratio"),
    )


def compiled(rules: Sequence[tuple[str, str, float | None, float | None]]) -> list[tuple[str, Column]]:
    """(rule, passes) for every row of the threshold table."""
    out = []
    for name, measure, low, high in rules:
        parts = [F.col(measure) >= F.lit(low)] * (low is not None) + [F.col(measure) <= F.lit(high)] * (high is not None)
        if not parts:
            raise ValueError(f"rule {name} has no bound")
        out.append((name, reduce(lambda a, b: a & b, parts)))
    return out


def judge(docs: DataFrame, *, rules=RULES, min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT, **columns) -> DataFrame:
    """Measures, `base_failed`, the list of failed rules and the verdict `kept` of every row."""
    checks = compiled(rules)
    rows = measured(docs, **columns)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks])) if checks else F.array().cast("array<string>")
    # the row number, always true, keeps a filter on the verdict above the measures: pushed below them it
    # would be evaluated with every measure written out in it, once per use
    here = F.monotonically_increasing_id() >= 0
    return rows.withColumn("base_failed", base).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & here)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with exactly their columns; one pass over the text."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{options.get('id_col', 'doc_id')}`").alias("_id"), F.col(f"`{options.get('text_col', 'text')}`").alias("_source_text"))
    judged = judge(held, **{**options, "id_col": "_id", "text_col": "_source_text", "keep": ("_row",)})
    return judged.filter("kept").select("_row.*")

