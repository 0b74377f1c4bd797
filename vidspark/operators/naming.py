"""Duplicate, misspelt and nickname entries among person names, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.functions.names import block_ratio, normalize_name, starts_lowercase, strip
from vidspark.operators.common import parameter_table, spread, top_per_group
from vidspark.params import MergeRules
from vidspark.session import cut_lineage


#: Letters that share an order of rarity by count; the others come before them, by code point.
COMMON = 1000
#: Keys a name may have per pair of lengths: so many, or a sixteenth of the names where that is less.
KEYS = 200


def _letters(forms: DataFrame) -> DataFrame:
    """`_t`: the letters of a form as (letter, occurrence), as many as it has letters."""
    chars = "filter(split(form, ''), c -> c <> '')"
    return forms.withColumn("_t", F.expr(f"transform({chars}, (c, i) -> concat(c, size(filter(slice({chars}, 1, i + 1), x -> x = c))))"))


def _by_rarity(forms: DataFrame, common: Sequence[str]) -> DataFrame:
    """`_t` from the rarest letter to the commonest; the order only has to be one and the same."""
    if not common:
        return forms
    order = F.create_map(*[F.lit(x) for pair in ((t, i) for i, t in enumerate(common)) for x in pair])
    keyed = F.transform("_t", lambda t: F.struct((-F.coalesce(order[t], F.lit(COMMON))).alias("o"), t.alias("t")))
    return forms.withColumn("_t", F.transform(F.array_sort(keyed), lambda x: x["t"]))


def _subset_size(most: int) -> str:
    """How many rare letters make a key: the most, up to six, that give the longer side at most `most` keys."""
    ways = {k: " * ".join(f"(_lb - _m + {j}) / {j}" for j in range(1, k + 1)) for k in range(6, 1, -1)}
    return "CASE " + " ".join(f"WHEN {n} <= {most} + 1e-6 AND _m >= {k} THEN {k}" for k, n in ways.items()) + " ELSE 1 END"


def _keys(forms: DataFrame, ratio: float, shorter: bool, keys: Sequence[str], lengths: Sequence[int], most: int) -> DataFrame:
    """Join keys of two lossless schemes, for the shorter or the longer side of a pair.

    A ratio of at least r means that at least m = r(la+lb)/2 characters match in order. What is left
    over on both sides damages at most that many of the shorter side's segments, so of one segment
    more at least one survives intact, moved by no more than the surplus. Both sides emit
    (la, lb, segment number, text).

    Where the segments would be shorter than three characters, rare letters are the keys: the two share m
    (letter, occurrence) tokens, so in one order of rarity the first s they share are
    among the first n - m + s of each side, and both emit every choice of s of those. `lengths`: those
    the other side has.
    """
    n = "CAST(length(form) AS INT)"
    other = f"sequence({n}, CAST(floor({n} * {2 - ratio} / {ratio} + 1e-9) AS INT))" if shorter else f"sequence(greatest(1, CAST(ceil({n} * {ratio} / {2 - ratio} - 1e-9) AS INT)), {n})"
    la, lb = (n, "_o") if shorter else ("_o", n)
    present = f"array({', '.join(map(str, lengths)) or '-1'})"
    sized = forms.filter("form <> ''").withColumn("_o", F.explode(F.expr(f"array_intersect({other}, {present})")))
    sized = sized.withColumn("_la", F.expr(la)).withColumn("_lb", F.expr(lb))
    sized = sized.withColumn("_m", F.expr(f"CAST(ceil({ratio} * (_la + _lb) / 2 - 1e-9) AS INT)"))
    sized = sized.withColumn("_k", F.expr("_la + _lb - 2 * _m + 1"))
    start, width = "CAST(floor(i * _la / _k) AS INT)", "CAST(floor((i + 1) * _la / _k) AS INT) - CAST(floor(i * _la / _k) AS INT)"
    if shorter:
        cut = f"transform(sequence(0, _k - 1), i -> struct(i AS seg, substring(form, {start} + 1, {width}) AS text))"
    else:
        moved = f"transform(sequence(greatest(0, {start} - (_la - _m)), least(_lb - ({width}), {start} + (_lb - _m))), p -> struct(i AS seg, substring(form, p + 1, {width}) AS text))"
        cut = f"array_distinct(flatten(transform(sequence(0, _k - 1), i -> IF({start} - (_la - _m) <= _lb - ({width}), {moved}, array()))))"
    sized = sized.withColumn("_c", F.expr(_subset_size(most)))
    grown = "concat(sets, transform(filter(sets, x -> size(x) < _c), x -> concat(x, array(t))))"
    chosen = f"filter(aggregate(slice(_t, 1, size(_t) - _m + _c), array(cast(array() AS array<string>)), (sets, t) -> {grown}), x -> size(x) = _c)"
    rare = f"transform({chosen}, x -> struct(-1 AS seg, array_join(x, '') AS text))"
    segs = F.explode(F.expr(f"IF(_k * 3 > _la, {rare}, {cut})"))
    return sized.withColumn("_s", segs).select(*keys, "form", "_la", "_lb", F.col("_s.seg").alias("_seg"), F.col("_s.text").alias("_text"))


def _bag_ok(a: str, b: str, ratio: float) -> str:
    """Upper bound of the ratio by shared characters, ignoring order."""
    shared = f"aggregate(array_distinct(split({a}, '')), 0, (s, c) -> s + least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))"
    return f"2 * {shared} >= {ratio} * (length({a}) + length({b})) - 1e-9"


def met_pairs(left: DataFrame, right: DataFrame, *, ratio: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, l, r, _la, _lb) of forms that share a key, once for every key they share."""
    keys = list(keys)
    # read several times below, and few bytes that unfold into many keys: computed once and dealt evenly. A shuffle by
    # the form would be left out where the forms are grouped by it already, and their partitions joined by size
    one = left is right
    left = cut_lineage(spread(left.select(*keys, "form")))
    right = left if one else cut_lineage(spread(right.select(*keys, "form")))
    letters = _letters(left.select("form")) if left is right else _letters(left.select("form").unionByName(right.select("form")))
    # at most COMMON letters, and the lengths that names have
    often = letters.select(F.explode("_t").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(COMMON)
    common = [r["t"] for r in often.collect()]
    sizes = [{r["n"]: r["c"] for r in x.filter("form <> ''").groupBy(F.length("form").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()} for x in ([left] if left is right else [left, right])]
    sizes = [sizes[0], sizes[-1]]
    most = max(8, min(KEYS, max(sum(x.values()) for x in sizes) // 16))
    a, b = (_by_rarity(_letters(x), common) for x in (left, right))

    def joined(short: DataFrame, long: DataFrame, s: str, l: str, short_sizes: dict, long_sizes: dict) -> DataFrame:  # noqa: E741
        x = _keys(short, ratio, True, keys, sorted(long_sizes), most).withColumnRenamed("form", s)
        y = _keys(long, ratio, False, keys, sorted(short_sizes), most).withColumnRenamed("form", l)
        return x.join(y, [*keys, "_la", "_lb", "_seg", "_text"]).filter("l <> r").select(*keys, "l", "r", "_la", "_lb")

    both = joined(a, b, "l", "r", *sizes)
    mirrored = both.select(*keys, F.col("r").alias("l"), F.col("l").alias("r"), "_la", "_lb") if left is right else joined(b, a, "r", "l", *sizes[::-1])
    return both.unionByName(mirrored)


def candidate_pairs(left: DataFrame, right: DataFrame, *, ratio: float, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, l, r) of forms whose matching-block ratio may reach `ratio` in either order.
    `left` and `right` hold `keys` and `form`, without duplicates; equal forms are not returned."""
    # unmatched characters on both sides bound the edit distance; checked before anything is shuffled
    surplus = f"CAST(_la + _lb - 2 * ceil({ratio} * (_la + _lb) / 2 - 1e-9) AS INT)"
    near = met_pairs(left, right, ratio=ratio, keys=keys).filter(F.expr(f"levenshtein(l, r, {surplus}) >= 0"))
    once = spread(near.select(*keys, "l", "r"), *keys, "l", "r").dropDuplicates([*keys, "l", "r"])
    return once.filter(F.expr(_bag_ok("l", "r", ratio)))


def scored_pairs(left: DataFrame, right: DataFrame, *, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates with their similarity read from l to r (the measure is not symmetric). The ratio is 1 for equal
    forms only, which are not returned: at a threshold of 100 there is no pair to look for."""
    if threshold >= 100:
        return left.select(*keys, F.col("form").alias("l"), F.col("form").alias("r"), F.lit(100.0).alias("similarity")).filter("l <> r")
    c = candidate_pairs(left, right, ratio=threshold / 100.0, keys=keys)
    return c.withColumn("similarity", block_ratio(F.col("l"), F.col("r"))).filter(F.col("similarity") >= threshold)


def similar_names(persons: DataFrame, *, name: str = "name", threshold: float = 90.0, sources: DataFrame | None = None) -> DataFrame:
    """(source, target, similarity) of distinct names whose comparison forms reach the threshold.
    `sources` narrows the names looked up; targets are always all names."""
    # used several times: computed once, on the different names and not on the rows they come from
    everyone = cut_lineage(persons.select(F.col(name).alias("target")).distinct().withColumn("form", normalize_name(F.col("target"))))
    looked = everyone if sources is None else sources.select(F.col(name).alias("target")).distinct().withColumn("form", normalize_name(F.col("target")))
    looked = looked.select(F.col("target").alias("source"), F.col("form").alias("l"))
    forms = everyone.select("form").distinct()
    asked = forms if sources is None else looked.select(F.col("l").alias("form")).distinct()
    scored = scored_pairs(asked, forms, threshold=threshold)
    equal = looked.select("l").distinct().select("l", F.col("l").alias("r"), F.lit(100.0).alias("similarity"))
    pairs = scored.select("l", "r", "similarity").unionByName(equal)
    out = looked.join(pairs, "l").join(everyone.withColumnRenamed("form", "r"), "r").filter("source <> target")
    return out.select("source", "target", F.round("similarity", 1).alias("similarity"))


def spelling_variants(persons: DataFrame, *, name: str = "name", pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """First other name, in name order, that carries the counterpart of a spelling found in the name.
    Per spelling only the two lowest names can be that target, so no pairs are formed."""
    low = F.lower(F.col(name))
    hits = [
        F.when(low.contains(text), F.struct(F.lit(i).alias("idx"), F.lit(side).alias("side")))
        for i, pair in enumerate(pairs) for side, text in enumerate(pair)
    ]
    found = persons.select(name).distinct().withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(name, "_h.*")
    lowest = top_per_group(found, ["idx", "side"], [F.col(name)], 2)
    targets = lowest.groupBy("idx", "side").agg(
        F.min(name).alias("_t1"), F.max(F.when(F.col("rank") == 2, F.col(name))).alias("_t2")
    ).withColumn("side", 1 - F.col("side"))
    # at most two rows per spelling pair
    met = found.join(F.broadcast(targets), ["idx", "side"])
    met = met.withColumn("target", F.when(F.col("_t1") != F.col(name), F.col("_t1")).otherwise(F.col("_t2"))).filter("target IS NOT NULL")
    best = met.groupBy(name).agg(F.min(F.struct("target", "idx", "side")).alias("_b"))
    words = parameter_table(persons.sparkSession, [(i, a, b) for i, (a, b) in enumerate(pairs)], "idx int, local string, international string")
    out = best.select(F.col(name).alias("source"), "_b.target", "_b.idx", "_b.side").join(words, "idx")
    return out.select(
        "source", "target", F.when(F.col("side") == 0, F.concat(F.lit("local "), "local", F.lit(" vs "), "international")).otherwise(
            F.concat(F.lit("international "), "international", F.lit(" vs "), "local")).alias("reason"),
    )


def nickname_matches(persons: DataFrame, *, name: str = "name", nicknames: Sequence[tuple[str, str]], surname_similarity: float = 80.0) -> DataFrame:
    """Nickname entries and the first full-name entry whose last name is more than 80 % similar."""
    parts = persons.select(name).distinct().withColumn("_p", F.split(strip(F.lower(F.col(name))), r"\s+")).filter(F.size("_p") > 1)
    parts = parts.select(name, F.element_at("_p", 1).alias("first"), F.element_at("_p", -1).alias("form"))
    table = parameter_table(persons.sparkSession, list(nicknames), "nick string, full string")
    nick = parts.join(table, parts["first"] == table["nick"]).select(name, "nick", "full", "form")
    full = parts.join(table, parts["first"] == table["full"]).groupBy("nick", "full", "form").agg(F.min(name).alias("target"))
    keys = ["nick", "full"]
    scored = scored_pairs(nick.select(*keys, "form").distinct(), full.select(*keys, "form"), threshold=surname_similarity, keys=keys)
    same = nick.select(*keys, F.col("form").alias("l"), F.col("form").alias("r")).distinct().withColumn("similarity", F.lit(100.0))
    ok = scored.filter(F.col("similarity") > surname_similarity).unionByName(same)
    met = nick.withColumnRenamed("form", "l").join(ok, [*keys, "l"]).join(full.withColumnRenamed("form", "r"), [*keys, "r"])
    best = met.filter(F.col(name) != F.col("target")).groupBy(name).agg(F.min(F.struct("target", "nick", "full")).alias("_b"))
    return best.select(F.col(name).alias("source"), "_b.target", F.concat("_b.nick", F.lit(" is short for "), "_b.full").alias("reason"))


def merge_candidates(persons: DataFrame, *, id: str = "person_id", name: str = "name", counts: DataFrame | None = None, rules: MergeRules = MergeRules()) -> DataFrame:
    """Merge candidates of one domain. The first rule that fits a name ends the search for it: typo,
    spelling variant, nickname, duplicate; an unordered pair is reported once, under the lower name."""
    # every rule reads the names: computed once, and no rule's filter is evaluated on the rows they come from
    persons = cut_lineage(spread(persons.select(id, name)))
    typo = persons.filter(starts_lowercase(F.col(name)))
    rest = persons.filter(~starts_lowercase(F.col(name)))
    near = similar_names(persons, name=name, threshold=rules.typo_similarity, sources=typo).groupBy("source").agg(F.min("target").alias("target"))
    typos = typo.select(F.col(name).alias("source")).join(near, "source", "left").select(
        "source", "target", F.lit("TYPO").alias("type"), F.lit("starts with a lower-case letter").alias("reason"), F.lit(None).cast("double").alias("similarity"),
        F.when(F.col("target").isNull(), "RENAME").otherwise("MERGE").alias("action"),
    )
    only = rest.select(F.col(name).alias("source"))
    # both are used by the rules after them: computed once
    spelled = cut_lineage(spelling_variants(persons, name=name, pairs=rules.spelling).join(only, "source", "left_semi"))
    nick = nickname_matches(persons, name=name, nicknames=rules.nicknames, surname_similarity=rules.surname_similarity)
    nick = cut_lineage(nick.join(only, "source", "left_semi").join(spelled, "source", "left_anti"))
    left_over = rest.select(name).join(spelled.unionByName(nick).select(F.col("source").alias(name)), name, "left_anti")
    dup = similar_names(persons, name=name, threshold=rules.duplicate_similarity, sources=left_over)

    def typed(df: DataFrame, kind: str) -> DataFrame:
        sim = F.col("similarity") if "similarity" in df.columns else F.lit(None).cast("double")
        why = F.col("reason") if "reason" in df.columns else F.concat(sim.cast("string"), F.lit("% name similarity"))
        return df.select("source", "target", F.lit(kind).alias("type"), why.alias("reason"), sim.alias("similarity"), F.lit("MERGE").alias("action"))

    found = typed(spelled, "SPELLING_VARIANT").unionByName(typed(nick, "NICKNAME")).unionByName(typed(dup, "DUPLICATE"))
    once = found.groupBy(F.least("source", "target").alias("_a"), F.greatest("source", "target").alias("_b")).agg(
        F.min_by(F.struct(*found.columns), F.col("source")).alias("_r")
    ).select("_r.*")
    out = typos.unionByName(once)
    ids = persons.select(F.col(id).alias("_id"), F.col(name).alias("_name"))
    out = out.join(ids.select(F.col("_name").alias("source"), F.col("_id").alias("source_id")), "source")
    out = out.join(ids.select(F.col("_name").alias("target"), F.col("_id").alias("target_id")), "target", "left")
    if counts is not None:
        for side in ("source", "target"):
            out = out.join(counts.select(F.col(id).alias(f"{side}_id"), F.col("n").alias(f"{side}_vectors")), f"{side}_id", "left")
    return out


def in_report_order(candidates: DataFrame) -> DataFrame:
    """Typos, duplicates, spelling variants, nicknames; then by name."""
    order = F.create_map(*[F.lit(x) for x in ("TYPO", 0, "DUPLICATE", 1, "SPELLING_VARIANT", 2, "NICKNAME", 3)])
    return candidates.orderBy(F.coalesce(order[F.col("type")], F.lit(99)), "source", "target")
