"""Language identification, word first with backoff to character n-grams.

A known word scores its log frequency in every language. An unseen one falls back to its character
n-grams (word ends marked): the longest order of which some n-gram is known counts, at half the weight
for each order given up. A text's scores are summed over its words and a prior; the share of the best
language is the score.

The model is fitted on a bounded sample of labelled rows: about `SAMPLE` documents of each language,
chosen by a hash of id and text; words and n-grams beyond `WORDS` and `GRAMS` per language and order are
left to the backoff. So the model has a fixed size, whatever the corpus. Every text is scored whole.

Defined results: a null text and one without a letter are `und` with score 0, and so is everything if no
row is labelled; null languages are not learned from; a null id counts as '' when texts are held out;
repeated rows are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.text import only
from vidspark.session import cut_lineage

SAMPLE, WORDS, GRAMS, ORDERS = 5_000, 50_000, 20_000, (4, 3, 2, 1)
UNKNOWN = "und"
#: Different unseen words whose scores a task remembers.
REMEMBERED = 100_000
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("_text"), strict=True):
            counts.update((lang, w) for w in words_of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, int, str]] = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for order in ORDERS:
                for g in grams_of(word, order):
                    counts[lang, order, g] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "kind", "item", "n"],
        )


def fit(labelled: DataFrame, *, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> tuple[list[str], np.ndarray, dict[int, dict[str, int]], np.ndarray]:
    """(languages, log prior, per kind (0: words, else the order) item -> row, rows of log frequencies).
    `labelled`: doc_id, lang, _text."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # languages, not rows
    if not sizes:
        return [], np.empty(0), {}, np.empty((0, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 20)) < share * (1 << 20))
    counts = cut_lineage(chosen.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    items = counts.select("lang", F.lit(0).alias("kind"), F.col("word").alias("item"), "n").unionByName(
        counts.mapInArrow(_gram_counts, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    )
    items = cut_lineage(items)
    totals = {(r["lang"], r["kind"]): r["n"] for r in items.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    order = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = items.withColumn("_r", order).filter(F.col("_r") <= F.when(F.col("kind") == 0, words).otherwise(grams)).drop("_r").collect()
    languages = sorted(sizes)
    at = {lang: k for k, lang in enumerate(languages)}
    places: dict[int, dict[str, int]] = {}
    for r in top:
        known = places.setdefault(r["kind"], {})
        known.setdefault(r["item"], len(known))
    base, tables = 0, []
    for kind, known in sorted(places.items()):
        n = np.array([totals.get((lang, kind), 0) for lang in languages], dtype=np.float64)
        seen = np.full((len(known), len(languages)), 0.5)
        for r in top:
            if r["kind"] == kind:
                seen[known[r["item"]], at[r["lang"]]] += r["n"]
        tables.append(np.log(seen / (n + 0.5 * (len(known) + 1))))
        places[kind] = {item: base + row for item, row in known.items()}
        base += len(known)
    prior = np.log(np.array([sizes[lang] for lang in languages], dtype=np.float64) / sum(sizes.values()))
    return languages, prior, places, np.concatenate(tables) if tables else np.empty((0, len(languages)))


def backoff(word: str, places: dict[int, dict[str, int]]) -> tuple[list[int], float]:
    """Rows of the n-grams that score a word outside the table of words, and the weight of each."""
    marked = f"^{word}$"
    weight = 1.0
    for order in ORDERS:
        get = places.get(order, {}).get
        found = [row for i in range(len(marked) - order + 1) if (row := get(marked[i : i + order])) is not None]
        if found:
            return found, weight / len(found)
        weight *= 0.5
    return [], 0.0


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    languages, prior, places, rows = model.value
    get = places.get(0, {}).get
    remembered: dict[str, tuple[list[int], float]] = {}
    for batch in batches:
        names, scores = [], []
        for value in batch.column("_text"):
            words = words_of(value.as_py())
            if not words or not languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
            sums = prior + rows[at[at >= 0]].sum(axis=0)
            parts: list[int] = []
            weights: list[float] = []
            for w in [words[k] for k in np.flatnonzero(at < 0)]:
                if w not in remembered:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[w] = backoff(w, places)
                found, weight = remembered[w]
                parts += found
                weights += [weight] * len(found)
            if parts:
                sums = sums + np.array(weights) @ rows[parts]
            best = int(sums.argmax())
            names.append(languages[best])
            scores.append(float(1 / np.exp(sums - sums[best]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    rows = only(docs, doc_id=id_col, lang=lang_col, _text=text_col).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    model = fit(rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("doc_id", "lang", "_text"), **bounds)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.select("doc_id", "held_out", "_text").mapInArrow(partial(_predict, model=docs.sparkSession.sparkContext.broadcast(model)), kind)
