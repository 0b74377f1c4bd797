"""Benchmarks, queues, admission and the tables they change. Changes make new snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidspark.functions.names import edit_similarity, same_person
from vidspark.functions.scalars import days_since, hours_since
from vidspark.operators.common import latest_per_key, numbered, top_per_group, with_group, with_previous
from vidspark.operators.graph import resolve_merges
from vidspark.session import cut_lineage
from vidspark.params import Admission

PRIORITIES = ("high", "medium", "low")


def priority_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "low", 2).otherwise(1)


def priority_name(rank: Column) -> Column:
    return F.when(rank == 0, "high").when(rank == 2, "low").otherwise("medium")


# ---------------------------------------------------------------- benchmarks


def benchmark_scores(results: DataFrame, *, person: str, found: str, recognized: str = "recognized", keys: Sequence[str] = ()) -> DataFrame:
    """Share of images recognised as the right person, and how urgent more training is."""
    right = F.col(recognized) & same_person(F.col(person), F.col(found))
    g = results.groupBy(person, *keys).agg(
        F.count(F.lit(1)).alias("images"), F.count_if(right).alias("correct"), F.count_if(F.col(recognized) & ~right).alias("wrong"),
        F.count_if(~F.col(recognized)).alias("not_recognized"),
    )
    score = F.round(F.col("correct") / F.col("images") * 100, 2)
    g = g.withColumn("score", score)
    urgency = F.when((F.col("score") < 30) | (F.col("wrong") >= 5), "high").when((F.col("score") < 50) | (F.col("wrong") >= 3), "medium")
    urgency = urgency.when(F.col("score") < 80, "low").otherwise("none")
    return g.withColumn("priority", urgency).withColumn("needs_training", F.col("priority") != "none")


def suspicious_labels(results: DataFrame, *, person: str, found: str, order: str, recognized: str = "recognized", low: float = 0.60, high: float = 0.95) -> DataFrame:
    """Wrong labels that look like the right name, first row of each."""
    wrong = results.filter(F.col(recognized) & F.col(found).isNotNull() & ~same_person(F.col(person), F.col(found)))
    once = wrong.groupBy(person, found).agg(F.min(order).alias("order"))
    sim = once.withColumn("_s", edit_similarity(F.col(person), F.col(found))).filter((F.col("_s") >= low) & (F.col("_s") < high))
    return sim.withColumn("similarity", F.round(F.col("_s") * 100, 1)).drop("_s")


def degraded(scores: DataFrame, *, person: str, ts: str, score: str, drop: float = 10.0) -> DataFrame:
    """Each benchmark against the one before of the same person."""
    return with_previous(scores, [person], [ts], [score]).withColumn(
        "degraded", F.coalesce(F.col(score) < F.col(f"prev_{score}") - drop, F.lit(False))
    )


def weakest(scores: DataFrame, *, below: float = 80.0) -> DataFrame:
    return scores.filter(F.col("score") < below).orderBy(priority_rank(F.col("priority")), "score", "person")


def last_runs(history: DataFrame, *, person: str, ts: str, n: int = 10) -> DataFrame:
    return top_per_group(history, [person], [F.col(ts).desc()], n)


def stable_sample(keys: DataFrame, *, key: str, n: int = 100, seed: int = 0) -> DataFrame:
    """At most n keys in the order of their md5 behind the seed: repeatable in any engine, and a
    distributed top-n."""
    return keys.select(key).distinct().orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


# ---------------------------------------------------------------- queue


def queue_state(events: DataFrame, *, person: str = "person", seq: str = "seq") -> DataFrame:
    """Queue after a history of add / update / remove / finish events.

    An entry lives from the first add after its last removal. An update sets the priority, an add
    afterwards can only raise it, `move_to_top` gives order 0. Folded by four aggregates per key.
    """
    action, s = F.col("action"), F.col(seq)
    gone = action.isin("remove", "finish")
    alive = with_group(events, [person], F.max(F.when(gone, s)).alias("_r")).filter(~gone & (F.col("_r").isNull() | (s > F.col("_r"))))
    alive = with_group(alive, [person], F.min(F.when(action == "add", s)).alias("_a")).filter(s >= F.col("_a"))
    alive = with_group(alive, [person], F.max(F.when(action == "update", s)).alias("_u"))
    settled = F.col("_u").isNull() | (s >= F.col("_u"))
    first = F.when(action == "add", s)
    return alive.groupBy(person).agg(
        F.min(F.when(settled, priority_rank(F.col("priority")))).alias("_rank"),
        F.min_by("source", first).alias("source"), F.min_by("score", first).alias("score"), F.min_by("ts", first).alias("added_at"),
        F.min(F.when((action == "update") & F.col("move_to_top"), F.lit(0))).alias("order"),
    ).withColumn("priority", priority_name(F.col("_rank"))).drop("_rank")


def raise_priority(entries: DataFrame, *, person: str = "person", seq: str = "seq") -> DataFrame:
    """Insert-or-raise: highest priority asked for, everything else from the first request."""
    rest = [c for c in entries.columns if c not in (person, seq, "priority")]
    return entries.groupBy(person).agg(
        F.min(priority_rank(F.col("priority"))).alias("_rank"), F.min_by(F.struct(*rest), F.col(seq)).alias("_f")
    ).select(person, priority_name(F.col("_rank")).alias("priority"), *[F.col(f"_f.{c}").alias(c) for c in rest])


def queue_order(queue: DataFrame, *, person: str = "person") -> DataFrame:
    """Position by priority, manual order, time of entry."""
    ranked = queue.withColumn("_p", priority_rank(F.col("priority"))).withColumn("_o", F.coalesce("order", F.lit(999999)))
    return numbered(ranked, [], ["_p", "_o", "added_at", person], name="position").drop("_p", "_o")


def due_queue(queue: DataFrame, history: DataFrame, *, as_of: Column, person: str = "person", ts: str = "ts", min_days: int = 7) -> DataFrame:
    """Entries not trained within `min_days` before `as_of`."""
    last = history.groupBy(person).agg(F.max(ts).alias("_last"))
    recent = last.filter(days_since(as_of, F.col("_last")) < min_days)
    return queue.join(recent, person, "left_anti")


def not_benchmarked_since(people: DataFrame, benchmarks: DataFrame, *, as_of: Column, person: str = "person", ts: str = "ts", hours: float = 24) -> DataFrame:
    last = benchmarks.groupBy(person).agg(F.max(ts).alias("_last"))
    return people.join(last.filter(hours_since(as_of, F.col("_last")) < hours), person, "left_anti")


def benchmark_and_queue(results: DataFrame, *, person: str, found: str) -> DataFrame:
    """Queue entries for everyone whose benchmark asks for training."""
    s = benchmark_scores(results, person=person, found=found).filter("needs_training")
    return s.select(F.col(person).alias("person"), "priority", F.lit("benchmark").alias("source"), "score")


def latest_flags(events: DataFrame, *, keys: Sequence[str], seq: str, on: Column) -> DataFrame:
    """Keys whose latest event switches them on (approvals, open checkpoints)."""
    return latest_per_key(events.withColumn("_on", on), list(keys), [seq]).filter("_on").drop("_on")


def open_checkpoints(events: DataFrame, *, key: str, seq: str, stage: str = "stage", done: str = "completed") -> DataFrame:
    """Unfinished items with the stage to resume from, oldest first."""
    latest = latest_per_key(events, [key], [seq])
    return latest.filter(F.col(stage) != done).orderBy(seq)


def session_state(events: DataFrame, *, session: str, seq: str) -> DataFrame:
    """Sessions from create / append / rename / complete events, counters derived."""
    a = F.col("action")
    return events.groupBy(session).agg(
        F.count_if(a == "append").alias("total"), F.count_if((a == "append") & F.col("success")).alias("successes"), F.count_if((a == "append") & ~F.col("success")).alias("failures"),
        F.max_by("label", F.when(a.isin("create", "rename"), F.col(seq))).alias("name"), F.max(a == "complete").alias("is_complete"), F.min(seq).alias("first_event"),
    )


# ---------------------------------------------------------------- admission


def admit_capped(new: DataFrame, existing: DataFrame, *, file: str = "filename", person: str = "person", day: str = "day", limits: Admission = Admission()) -> DataFrame:
    """Newest files first, at most `per_person` files per person and `per_day` per person and day,
    counting what is there; files without person or date always enter.

    A file refused for its day does not use up the person's total, so the daily winners are chosen
    first and the total is drawn from them. Both are limited before their shuffle; the refused rows
    are labelled by the file name at which the total was reached.
    """
    fresh = cut_lineage(new.join(existing.select(file), file, "left_anti"))  # read four times below: joined once
    dated = F.col(person).isNotNull() & (F.col(person) != "") & F.col(day).isNotNull() & (F.col(day) != "")
    free, bound = fresh.filter(~F.coalesce(dated, F.lit(False))), fresh.filter(F.coalesce(dated, F.lit(False)))
    per_day = existing.groupBy(person, day).agg(F.count(F.lit(1)).alias("_day"))
    total = per_day.groupBy(person).agg(F.sum("_day").alias("_total"))
    order = [F.col(file).desc()]
    key = bound.select(file, person, day)
    daily = top_per_group(key, [person, day], order, limits.per_day, "_d").join(per_day, [person, day], "left")
    daily = daily.filter(F.col("_d") + F.coalesce("_day", F.lit(0)) <= limits.per_day).select(file, person)
    chosen = top_per_group(daily, [person], order, limits.per_person, "_n").join(total, person, "left")
    chosen = chosen.filter(F.col("_n") + F.coalesce("_total", F.lit(0)) <= limits.per_person)
    # where the total is reached, files sorting after (below) this one are refused for it
    filled = chosen.groupBy(person).agg(F.max(F.col("_n") + F.coalesce("_total", F.lit(0))).alias("_have"), F.min(file).alias("_last"))
    filled = filled.join(total, person, "full_outer").select(
        person, F.when(F.col("_total") >= limits.per_person, F.lit(True)).otherwise(F.lit(False)).alias("_full"), F.when(F.col("_have") >= limits.per_person, F.col("_last")).alias("_last")
    )
    marked = bound.join(chosen.select(file, F.lit(True).alias("_in")), file, "left").join(filled, person, "left")
    over_total = F.coalesce("_full", F.lit(False)) | F.coalesce(F.col(file) < F.col("_last"), F.lit(False))
    reason = F.when(F.col("_in"), F.lit(None).cast("string")).when(over_total, "person_limit").otherwise("daily_limit")
    out = marked.withColumn("admitted", F.coalesce("_in", F.lit(False))).withColumn("reason", reason).drop("_in", "_full", "_last")
    return out.unionByName(free.withColumn("admitted", F.lit(True)).withColumn("reason", F.lit(None).cast("string")))


def stop_at_target(candidates: DataFrame, *, group: str, seq: str, accepted: str, target: int = 40, already: int = 0, first_chunk: int = 50, next_chunk: int = 30, max_total: int = 150) -> DataFrame:
    """Candidates in sequence until `target` are accepted: a chunk of 50, then chunks of 30 while
    fewer than `max_total` were fetched; a chunk without any acceptance ends the group."""
    last_start = first_chunk + next_chunk * -(-(max_total - first_chunk) // next_chunk) - next_chunk
    reach = last_start + next_chunk if max_total > first_chunk else first_chunk
    tried = top_per_group(candidates, [group], [F.col(seq)], reach, "_n")
    chunk = F.when(F.col("_n") <= first_chunk, 0).otherwise(F.ceil((F.col("_n") - first_chunk) / next_chunk)).cast("int")
    tried = tried.withColumn("_chunk", chunk).withColumn("_hit", F.col(accepted).cast("long"))
    from pyspark.sql import Window as W

    before = W.partitionBy(group).orderBy("_n").rowsBetween(W.unboundedPreceding, -1)  # at most `reach` rows per group
    tried = tried.withColumn("_before", F.coalesce(F.sum("_hit").over(before), F.lit(0)) + already)
    chunks = tried.groupBy(group, "_chunk").agg(F.sum("_hit").alias("_c")).filter("_c = 0").groupBy(group).agg(F.min("_chunk").alias("_dry"))
    out = tried.join(chunks, group, "left")
    out = out.filter((F.col("_before") < target) & (F.col("_dry").isNull() | (F.col("_chunk") <= F.col("_dry"))))
    return out.withColumn("accepted_so_far", F.col("_before") + F.col("_hit")).drop("_n", "_chunk", "_hit", "_before", "_dry")


# ---------------------------------------------------------------- snapshots


def upsert(snapshot: DataFrame, changes: DataFrame, *, keys: Sequence[str], mode: str = "coalesce", order: str | None = None) -> DataFrame:
    """New snapshot. `coalesce`: non-null changes win per column, in `order`; `last`: the latest change
    replaces the row."""
    keys = list(keys)
    rest = [c for c in snapshot.columns if c not in keys]
    if mode == "last":
        news = latest_per_key(changes, keys, [order]) if order else changes.dropDuplicates(keys)
        return snapshot.join(news, keys, "left_anti").unionByName(news.select(snapshot.columns))
    stamp = F.col(order) if order else F.lit(1)
    news = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(f"_n_{c}") for c in rest])
    joined = snapshot.join(news, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in rest])


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    return parents.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")


def apply_decisions(persons: DataFrame, vectors: DataFrame, decisions: DataFrame, *, id: str = "person_id") -> tuple[DataFrame, DataFrame]:
    """MERGE / RENAME / DELETE / SKIP decisions (source_id, action, target_id, new_name) on persons and
    their vectors. Chains of merges are followed to their end before anything moves."""
    merges = resolve_merges(decisions.filter("action = 'MERGE' AND target_id IS NOT NULL"))
    merges = merges.select(F.col("source_id").alias(id), F.col("target_id").alias("_to"))
    deletes = decisions.filter("action = 'DELETE'").select(F.col("source_id").alias(id)).distinct()
    renames = decisions.filter("action = 'RENAME' AND new_name IS NOT NULL").groupBy(F.col("source_id").alias(id)).agg(F.max("new_name").alias("_new"))
    moved = vectors.join(merges, id, "left").withColumn(id, F.coalesce("_to", id)).drop("_to")
    kept = persons.join(merges, id, "left_anti").join(deletes, id, "left_anti").join(renames, id, "left")
    kept = kept.withColumn("name", F.coalesce("_new", "name")).drop("_new")
    return kept, moved.join(deletes, id, "left_anti")


def rename_prefix(files: DataFrame, merges: DataFrame, *, path: str, person: str) -> DataFrame:
    """File names moved to the merge target's prefix; a name that is taken, or asked for twice, keeps
    the old one. `merges` holds (person, target)."""
    asked = files.join(merges.select(person, F.col("target").alias("_to")), person, "left")
    prefix = F.concat(F.translate(F.col(person), " ", "_"), F.lit("_"))
    moved = F.concat(F.translate("_to", " ", "_"), F.lit("_"), F.substr(F.col(path), F.length(prefix) + 1))
    asked = asked.withColumn("_want", F.when(F.col("_to").isNotNull() & F.startswith(F.col(path), prefix), moved))
    taken = files.select(F.col(path).alias("_want")).distinct().withColumn("_taken", F.lit(True))
    first = asked.filter("_want IS NOT NULL").groupBy("_want").agg(F.min(path).alias("_winner"))
    out = asked.join(taken, "_want", "left").join(first, "_want", "left")
    ok = F.col("_want").isNotNull() & F.col("_taken").isNull() & (F.col("_winner") == F.col(path))
    return out.withColumn("new_path", F.when(ok, F.col("_want")).otherwise(F.col(path))).withColumn("renamed", F.coalesce(ok, F.lit(False))).drop("_want", "_taken", "_winner", "_to")


def promote(staging: DataFrame, production: DataFrame, *, folder: str, file: str, digest: str, today: str, minimum: int = 5) -> tuple[DataFrame, DataFrame]:
    """(files to copy with generated names, report per folder). Folders with fewer than `minimum` images
    are skipped; content already in production, or seen earlier in the folder, is not copied."""
    sized = with_group(staging, [folder], F.count(F.lit(1)).alias("_n"))
    ready = sized.filter(F.col("_n") >= minimum)
    fresh = ready.join(production.select(folder, digest).distinct(), [folder, digest], "left_anti")
    once = fresh.groupBy(folder, digest).agg(F.min_by(F.struct(*[c for c in staging.columns if c not in (folder, digest)]), F.col(file)).alias("_f"))
    once = once.select(folder, digest, *[F.col(f"_f.{c}").alias(c) for c in staging.columns if c not in (folder, digest)])
    named = numbered(once, [folder], [file], name="_i").withColumn(
        "new_name", F.concat(F.col(folder), F.lit(f"_{today}_"), F.lpad(F.col("_i").cast("string"), 6, "0"), F.lower(F.regexp_extract(F.col(file), r"(\.[^.]*)$", 1)))
    ).drop("_i")
    copied = named.groupBy(folder).agg(F.count(F.lit(1)).alias("copied"))
    report = staging.groupBy(folder).agg(F.count(F.lit(1)).alias("images")).join(copied, folder, "left")
    n = F.coalesce("copied", F.lit(0))
    status = F.when(F.col("images") < minimum, "too_few_images").when(n == 0, "all_duplicates").otherwise("deployed")
    report = report.withColumn("status", status).withColumn("copied", n).withColumn("duplicates", F.when(F.col("images") < minimum, 0).otherwise(F.col("images") - n))
    return named, report


def retain(rows: DataFrame, *, day: str, as_of: str, days: int = 7, size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows and bytes freed per day): partitions older than `days` before `as_of` go."""
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    old = rows.filter(F.col(day).cast("date") < cutoff)
    freed = old.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), (F.sum(size) if size else F.lit(None).cast("long")).alias("bytes"))
    return rows.filter(F.col(day).cast("date") >= cutoff), freed


def enrich_names(df: DataFrame, mapping: DataFrame, *, name: str, order: str) -> DataFrame:
    """`display`: the original of a normalised name, first writer wins, else spaces for underscores."""
    first = mapping.groupBy(F.col("normalized").alias(name)).agg(F.min_by("original", order).alias("_o"))
    return df.join(first, name, "left").withColumn("display", F.coalesce("_o", F.translate(name, "_", " "))).drop("_o")


def approved_only(trained: DataFrame, approvals: DataFrame, *, person: str) -> DataFrame:
    """Trained persons (underscores) that are approved (spaces)."""
    ok = approvals.select(F.translate(person, " ", "_").alias(person)).distinct()
    return trained.join(ok, person, "left_semi")
