"""The operators that are DataFrame expressions only: awkward rows, brute force, plans."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import AWKWARD, LONG, awkward, empty
from vidspark.llm import chat, content_sort, mixing, quality_rules
from vidspark.llm.queries import QUERIES

WS = re.compile("[ \t-\r]+")


def words(text):
    return [w for w in WS.split(text or "") if w]


# quality rules

def plain_measures(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + o for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("extra", [True, False])
def test_measures(spark, extra):
    got = quality_rules.judge(awkward(spark, extra)).collect()
    want = Counter((r[0], *plain_measures(r[1])) for r in AWKWARD)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.judge(empty(spark)).collect() == []


def test_repeats_by_chance(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: plain_measures(t)[4] for i, t in texts}


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "plain words in a row with the rest " * 3 + " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string")
    assert quality_rules.judge(docs).first()["kept"]
    assert quality_rules.judge(docs, rules=[("short", "word_length", 30.0, None)]).first()["failed_rules"] == ["short"]
    kept = quality_rules.kept_documents(awkward(spark))
    assert kept.columns == awkward(spark).columns
    with pytest.raises(ValueError):
        quality_rules.compiled([("open", "word_length", None, None)])


# content sort

@pytest.mark.parametrize("extra", [True, False])
def test_exact_groups(spark, extra):
    got = content_sort.decisions(awkward(spark, extra)).collect()
    norm = lambda t: WS.sub(" ", t or "")
    for r in got:
        same = [x for x in AWKWARD if hashlib.sha256(norm(x[1]).encode()).hexdigest() == r["text_sha256"]]
        known = [x[0] for x in same if x[0] is not None]
        assert r["group_size"] == len(same) and r["keep_id"] == (min(known) if known else None)
    assert Counter(r["doc_id"] for r in got if r["kept"]) == Counter([1, 3, 5, 6, 7, 8, 9])
    assert content_sort.decisions(empty(spark)).collect() == []
    kept = content_sort.first_copies(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_hot_texts(spark):
    """Copies of two texts make up most rows; each is sorted in several runs, one row of each stays."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").when(F.col("id") % 3 == 1, "also\nhot").otherwise(F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "hot text"), (3, "hot text"), (0, "hot text")], "doc_id long, text string"))
    assert content_sort.hot_hashes(docs.select(F.col("text").alias("_t")), 8)
    got = content_sort.decisions(docs).collect()
    kept = [r for r in got if r["kept"]]
    assert len(got) == 6003 and len(kept) == 2002
    assert {(r["doc_id"], r["group_size"]) for r in kept if r["group_size"] > 1} == {(0, 2003), (1, 2000)}
    plan = content_sort.decisions(docs)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "Python" not in plan


# mixing

def test_mix_targets_and_bounds(spark, sf):
    rows = QUERIES["op1_pareto_mix"](spark, sf).collect()
    again = QUERIES["op1_pareto_mix"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sizes = {r["doc_id"]: len(words(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, per = Counter(), {}
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        total[sources[r["doc_id"]]] += r["taken"]
        per[sources[r["doc_id"]]] = (r["source_size"], r["target"])
    # the stated rule, step by step
    own = {s: sum(sizes[d] for d in sizes if sources[d] == s) for s in per}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own))}
    target, free, budget = {}, set(own), 1.5 * sum(own.values())
    while free:
        share = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > 2 * own[s]}
        target |= {s: 2.0 * own[s] for s in above} if above else {s: share * weight[s] for s in free}
        free -= above or free
    for s, (size, goal) in per.items():
        assert size == own[s] and goal == pytest.approx(target[s])
        assert abs(total[s] - goal) <= max(20, 0.1 * goal), (s, total[s], goal)  # ten documents a source here
    assert sum(abs(total[s] - goal) for s, (_, goal) in per.items()) < 0.02 * sum(target.values())


@pytest.mark.parametrize("extra", [True, False])
def test_mix_awkward(spark, extra):
    rows = mixing.mix(awkward(spark, extra)).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((x[0], len(words(x[1]))) for x in AWKWARD)
    mixed = mixing.mixed_documents(awkward(spark, extra))
    assert mixed.columns == awkward(spark, extra).columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in rows), Counter())
    assert mixing.mix(empty(spark)).collect() == [] and mixing.mixed_documents(empty(spark)).collect() == []


def test_one_hot_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert all(abs(r["t"] - r["goal"]) <= 50 for r in rows)


def test_larger_documents_are_likelier(spark):
    """Inclusion follows the square root of the size: 4 times the size, twice as often."""
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.when(F.col("id") % 2 == 0, 4).otherwise(16)).alias("text"), F.lit("a").alias("source"))
    got = {r["size"]: r["m"] for r in mixing.mix(docs, weights=(1,), share=0.3).groupBy("size").agg(F.avg(F.col("copies")).alias("m")).collect()}
    assert got[16] / got[4] == pytest.approx(2, abs=0.25)


@pytest.mark.parametrize("share", [0.05, 0.25, 0.5])
@pytest.mark.parametrize(("many", "small", "giant"), [(1000, 100, 100_000), (200, 200, 20_020), (3, 7, 1_000_000), (0, 1, 5000)])
def test_one_giant_document_per_source(spark, share, many, small, giant):
    """40 sources of the same sizes are 40 draws: each ends within half of the smallest document it leaves out."""
    rows = spark.range(40 * (many + 1)).select(F.col("id").alias("doc_id"), F.format_string("s%02d", F.col("id") % 40).alias("source"), F.when(F.col("id") < 40, giant).otherwise(small).cast("long").alias("size"))
    out = mixing.with_copies(rows, *mixing.plan(rows, weights=(1,), share=share))
    per = out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("goal"), F.min(F.when(F.col("copies") == 0, F.col("size"))).alias("out")).collect()
    assert len(per) == 40
    for r in per:
        assert r["goal"] == pytest.approx(share * (many * small + giant))
        assert abs(r["t"] - r["goal"]) <= max((r["out"] or 0) / 2, 1) or r["t"] + (r["out"] or 0) > r["goal"] > r["t"] and r["goal"] - r["t"] <= r["out"] / 2, r


def test_many_sizes_close_the_gap(spark):
    """Sizes over five orders of magnitude, some ids repeated: what is left is less than half of any document outside."""
    rng = random.Random(4)
    data = [(i // 2 if i % 10 == 0 else i, "ab"[i % 2], int(10 ** rng.uniform(0, 5))) for i in range(3000)]
    rows = spark.createDataFrame(data, "doc_id long, source string, size long")
    out = mixing.with_copies(rows, *mixing.plan(rows, weights=(1, 1), share=0.4)).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        taken, goal = sum(r["size"] * r["copies"] for r in own), own[0]["target"]
        assert abs(taken - goal) <= 2 * min(r["size"] for r in own if not r["copies"])
        assert max(r["copies"] for r in own) == 1


def test_certain_documents_come_first(spark):
    """Where a document's inclusion reaches 1 and it fits, every draw has it."""
    rows = spark.range(40 * 101).select(F.col("id").alias("doc_id"), F.format_string("s%02d", F.col("id") % 40).alias("source"), F.when(F.col("id") < 40, 1600).otherwise(100).cast("long").alias("size"))
    out = mixing.with_copies(rows, *mixing.plan(rows, weights=(1,), share=0.5))
    assert out.filter("size = 1600").agg(F.min("copies"), F.max("copies")).first()[:] == (1, 1)


# chat

def test_escaping_is_reversible(spark):
    texts = ["<s>", "</s>", r"<\s>", r"<\\/s>", "[INST]", r"[\/INST] <<s>>", "<s", "\\<s>\\", "[/SYS][SYS]", "", "a\nb", "</s>\n<s>user\nx</s>\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r["u"] == r["t"] and not re.search(r"[<\[]/?(s>|INST\]|SYS\])", r["e"])


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "one " * 30), (1, 2, "assistant", "</s> two " * 30), (1, 3, "user", None), (1, 4, "assistant", "<s>user\nthree " * 30), (1, 5, "assistant", "é𝒳 four"),
    (2, 0, "user", ""), (2, 0, "user", ""), (2, None, None, "late"), (2, 1, "assistant", ""), (None, 3, "odd role\n<s>", LONG), (None, 1, "assistant", LONG), (3, 0, "assistant", "only"),
]


@pytest.mark.parametrize(("budget", "history"), [(12, 4), (140, 100), (10_010, 10)])
def test_windows_read_back(spark, budget, history):
    turns = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, window string, span int")
    formatted = chat.windows(turns, budget=budget, history=history)
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        assert back[conv]["n_turns"] == len(own)
        assert back[conv]["turns"] == "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        assert back[conv]["loss"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
    for r in formatted.filter("conv_id = 1").collect():
        assert r["text"].startswith("<s>system\nbe kind</s>\n")
        own = r["text"].count("<s>") - r["n_repeated"]
        assert own >= 1
    if budget == 140:
        assert formatted.filter("conv_id = 1 and n_repeated > 1").count() > 0
    assert chat.windows(turns.limit(0)).collect() == []


def plain_windows(sizes, system, budget, history):
    """Tokens of each window, by a loop over the turns."""
    kept = sizes[0] if system and 2 * sizes[0] <= budget else 0
    room = budget - kept
    width = room - min(history, room // 2)
    groups, at, starts = {}, 0, []
    for k, n in enumerate(sizes):
        starts.append(at)
        groups.setdefault((at // width, at // width < (at + n - 1) // width), []).append(k)
        at += n
    out = []
    for own in groups.values():
        new = sum(sizes[k] for k in own)
        past = [k for k in range(own[0]) if starts[k] >= starts[own[0]] - max(0, min(history, room - new))]
        out.append((new + sum(sizes[k] for k in past) + (kept if own[0] > 0 and 0 not in past else 0), len(own), new > room))
    return out


@pytest.mark.parametrize(("budget", "history"), [(60, 0), (60, 20), (60, 500), (1536, 512)])
def test_no_window_exceeds_its_budget(spark, budget, history):
    """System turn, history and new turns together; only a turn longer than the room, alone, is larger."""
    rng, turns, want = random.Random(budget + history), [], {}
    shapes = [([701] * 8, False), ([3001] + [200] * 9, True), ([30] + [budget - 29] * 3 + [budget] * 2, True)]
    shapes += [([rng.choice([1, 2, 5, 20, 45, 90]) for _ in range(rng.randint(1, 40))], rng.random() < 0.6) for _ in range(60)]
    for conv, (sizes, system) in enumerate(shapes):
        turns += [(conv, k, "system" if system and k == 0 else ("user", "assistant")[k % 2], "w " * (n - 1)) for k, n in enumerate(sizes)]
        want[conv] = plain_windows(sizes, system, budget, history)
    got = {}
    for r in chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=budget, history=history).collect():
        got.setdefault(r["conv_id"], []).append((r["window"], r["n_tokens"]))
    for conv, windows in want.items():
        assert [n for _, n in sorted(got[conv])] == [n for n, _, _ in windows]
        assert all(n <= budget or (count == 1 and longer) for n, count, longer in windows)


def test_native_plans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (quality_rules.judge(docs), quality_rules.kept_documents(docs), mixing.mix(docs), chat.windows(spark.read.parquet(f"{sf}/conversations.parquet"))):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
