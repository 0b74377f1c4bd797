r"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base. Each kind is one regular expression, leftmost and non-overlapping; matches that fail the kind's
test are dropped. Positions come from the pieces between matches: `split` and `regexp_extract_all` walk
over the text in the same way, so the lengths of pieces and matches add up to the starts. The expressions
are the stated ones written without the recursion and rescanning that very long texts would not survive
(possessive quantifiers, a start only where a run begins or a match ended).

Bootstrapping. Words with a digit or an @ are the instances; the words around an instance and its kind of
shape are its patterns (left word, right word). Instances that are base matches are seeds of their kind.
Rounds of scoring over the pattern-instance graph: a pattern's confidence in a kind is the confidence its
instances have in it, over all their occurrences, shrunk for rare patterns; an instance's is that of its
best pattern. Patterns with enough different seed values and a high final confidence discover their
other instances as `context` spans. Counts are grouped per (pattern, instance) first, so that a frequent
pattern is no hot key, and no pair of instances is ever formed.

Defined results: null counts as empty; a null id stays null; repeated rows each get their spans; texts are
scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.llm.text import only
from vidspark.session import stored

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
#: Rounds of scoring, least confidence, different seed values a pattern needs, shrinkage.
ROUNDS, LEAST, SUPPORT, SHRINK = 3, 0.8, 3, 1.0

# The stated expressions, position by position equal to
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9]*+(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: The nearest word in the text before and behind a token.
BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
BEHIND = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)"
#: Matches whose places are summed up in one go; the sums of such parts are summed up in turn.
PART = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.try_to_number(d, F.lit("9")).cast("int") * 2).otherwise(F.try_to_number(d, F.lit("9")).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)) - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        length = F.char_length(_digits(match))
        return F.when((length >= 14) & (length <= 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """(matches, pieces between them)."""
    here = text.rlike(needs)
    none = F.array().cast("array<string>")
    return F.when(here, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(here, F.split(text, pattern, -1)).otherwise(none)


def with_base(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text and per kind the list of spans (start, end, match)."""
    rows = only(docs, doc_id=id_col, _text=text_col).withColumn("_text", F.coalesce("_text", F.lit("")))
    for kind in KINDS:
        found, pieces = spans_of(F.col("_text"), PATTERNS[kind], NEEDS[kind])
        rows = rows.withColumn("_m", found).withColumn("_p", F.when(F.size("_m") > 0, pieces))
        test = partial(passes, kind)
        rows = _placed(rows, f"_{kind}").withColumn(f"_{kind}", F.filter(f"_{kind}", lambda s: test(s["match"]))).drop("_m", "_p")  # noqa: B023
    return rows


def _sums(items: Column, size, kind: str) -> Column:
    """Every item with the sum of the sizes before it, as (at, total of all, out). Copies the list for each
    item, so it is for lists of up to about `PART`."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(items, begin, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("x")))).alias("out")))


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """`rows` with `name`: the spans (start, end, match) of the matches _m between the pieces _p. Starts are sums
    over what comes before, inside parts of `PART` matches and then over the parts: never a list per match."""
    item, span = "struct<gap:long,size:long,match:string>", "array<struct<start:long,end:long,match:string>>"
    gaps = F.slice(F.coalesce("_p", F.array().cast("array<string>")), F.lit(1), F.size("_m"))
    rows = rows.withColumn("_i", F.zip_with(gaps, F.col("_m"), lambda p, m: F.struct(F.char_length(p).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size"), m.alias("match"))))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_i") - 1) / PART)), lambda k: F.slice("_i", (k * PART + 1).cast("int"), F.lit(PART)))
    parts = F.transform(cuts, lambda part: _sums(part, lambda x: x["gap"] + x["size"], f"struct<start:long,x:{item}>"))
    rows = rows.withColumn("_c", F.when(F.size("_i") > 0, parts))
    tops = _sums(F.transform("_c", lambda c: c["at"]), lambda x: x, "struct<start:long,x:long>")["out"]
    placed = F.zip_with(F.col("_c"), tops, lambda c, top: F.transform(c["out"], lambda s: F.struct(
        (top["start"] + s["start"] + s["x"]["gap"]).alias("start"), (top["start"] + s["start"] + s["x"]["gap"] + s["x"]["size"]).alias("end"), s["x"]["match"].alias("match"))))
    return rows.withColumn(name, F.when(F.size("_i") > 0, F.flatten(placed)).otherwise(F.array().cast(span))).drop("_i", "_c")


def _met(spans: str, start: Column, end: Column) -> Column:
    """Whether a span of the sorted list in column `spans` meets [start, end): the first that ends behind
    `start`, found by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)))
    begin = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        behind = F.get(F.col(spans), middle)["end"] > start
        done = acc["low"] >= acc["high"]
        return F.struct(F.when(done | behind, acc["low"]).otherwise(middle + 1).alias("low"), F.when(done | ~behind, acc["high"]).otherwise(middle).alias("high"))

    first = F.get(F.col(spans), F.aggregate(steps, begin, step)["low"])
    return F.when(F.size(spans) > 0, F.coalesce(first["start"] < end, F.lit(False))).otherwise(F.lit(False))


def listed(spans: Column) -> Column:
    """kind:start:end of (start, rank, kind, end) structs, in order, joined by commas."""
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _ranked() -> Column:
    def of(rank: int, kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    return F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)])


def instances(rows: DataFrame) -> DataFrame:
    """_row, start, end, value (lower case), kind (null: no base match), left, right of every word with a
    digit or @. `rows`: _row, _text and the base spans per kind."""
    found, pieces = spans_of(F.col("_text"), TOKEN, r"[0-9@]")
    rows = rows.select("_row", *[f"_{k}" for k in KINDS], found.alias("_m"), pieces.alias("_p")).filter(F.size("_m") > 0)
    rows = _placed(rows, "_s")
    # the word before and behind; where the neighbour is an instance itself, it counts as a number
    word = lambda piece, pattern: F.lower(F.regexp_extract(piece, pattern, 1))
    near = F.transform(F.col("_s"), lambda s, i: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("value"),
        F.coalesce(*[F.when(_met(f"_{k}", s["start"], s["end"]), F.lit(k)) for k in KINDS]).alias("kind"),
        word(F.get(F.col("_p"), i), BEFORE).alias("left"), word(F.get(F.col("_p"), i + 1), BEHIND).alias("right"),
    ))
    return rows.select("_row", F.explode(near).alias("i")).select("_row", "i.*")


def confident_patterns(found: DataFrame, *, rounds: int = ROUNDS, least: float = LEAST, support: int = SUPPORT, shrink: float = SHRINK) -> DataFrame:
    """(side, word) of patterns whose instances are identifiers, by iterated scores of the graph."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("word")), F.struct(F.lit("right").alias("side"), F.col("right").alias("word"))))
    edges = found.select("value", "kind", sides.alias("p")).select("p.side", "p.word", "value", "kind").filter("word <> ''")
    edges = stored(edges.groupBy("side", "word", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind").isNotNull().cast("double")).alias("seed")))
    trust = edges.groupBy("value").agg(F.max("seed").alias("trust"))
    for _ in range(rounds):
        scored = edges.join(trust, "value").groupBy("side", "word").agg(
            (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + shrink)).alias("confidence"), F.sum("seed").alias("seeds"),
        ).filter(F.col("seeds") >= support)
        trust = stored(edges.join(scored, ["side", "word"], "left").groupBy("value").agg(F.greatest(F.max("seed"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("trust")))
    return scored.filter(F.col("confidence") >= least).select("side", "word")


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base and context), n_context of every row."""
    rows = with_base(docs, id_col=id_col, text_col=text_col).withColumn("_row", F.monotonically_increasing_id()).withColumn("_base", _ranked())
    near = instances(rows)
    base = rows.select("_row", "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "_base")
    # one pass over the texts writes both: a row per text, and one per instance
    both = base.select("_row", F.struct("doc_id", *[f"n_{k}" for k in KINDS], "_base").alias("base"))
    base, near = stored(both.select("_row", "base.*")), stored(near)
    patterns = confident_patterns(near, **options)
    free = near.filter("kind is null")
    hits = reduce(DataFrame.unionByName, [
        free.join(patterns.filter(F.col("side") == side).select(F.col("word").alias(side)), side, "left_semi").select("_row", "start", "end") for side in ("left", "right")
    ]).distinct()
    more = hits.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(CONTEXT).alias("kind"), "end")).alias("_more"))
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>")
    out = base.join(more, "_row", "left").withColumn("_more", F.coalesce("_more", none))
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("_base", "_more")).alias("spans"), F.size("_more").cast("long").alias("n_context"),
    )
