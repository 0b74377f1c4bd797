r"""Chat formatting in budgeted windows.

A window holds at most `budget` tokens in all: the system turn (retained in every window), some history
(whole turns before the new ones, repeated, at most `history` tokens) and the new turns. What the system
turn leaves is the room; new turns go by prefix sums of turn tokens into cells of the width room - history
(at least half the room). The turns inside one cell make one window's new turns, and a turn that crosses a
cell's end makes a window of its own, so no rest of a turn overshoots. History gets what is left of the room,
so it is dropped first. Only a single turn longer than the room exceeds the budget: turns are never cut. A
system turn of more than half the budget would leave no room; it stands once, in its place, like any turn.
Assistant texts among the new turns carry the loss; repeated ones are masked, so each is learned from once.

Template: `<s>role\ntext</s>\n` per turn. Control strings inside texts get a backslash behind their first
character, one more if some stand there already, which is undone exactly. A role of other characters than
letters, digits, _ and - is written as base64 behind `b64:`.

Defined results: a null text is empty, a null role too; turns are ordered by turn, role and text, null
turns last; repeated rows are turns of their own; a null conv_id is one conversation; an empty table
gives an empty result; other columns are ignored. A conversation is read back as a whole, so one
conversation's text must fit a task; conversations are spread freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vidspark.llm.text import only, trimmed, word_count
from vidspark.session import stored

BUDGET, HISTORY = 1536, 512
BEGIN, END, ROLE_END = "<s>", "</s>\n", "\n"
#: The template's control strings, and those of a widespread other one.
CONTROL = r"(/?(?:s>|INST\]|SYS\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def _role(role: Column) -> Column:
    plain = role.rlike(r"^[A-Za-z0-9_-]*$") & ~role.contains("\n")
    return F.when(plain, role).otherwise(F.concat(F.lit("b64:"), F.regexp_replace(F.base64(F.encode(role, "UTF-8")), r"[\r\n]+", "")))


def _role_back(role: Column) -> Column:
    return F.when(role.startswith("b64:"), F.decode(F.unbase64(F.substring(role, 5, 1 << 30)), "UTF-8")).otherwise(role)


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, window, text, n_repeated (turns at its head that repeat), loss (start, length of the learned
    texts, in characters), n_tokens."""
    if budget < 2 or history < 0:
        raise ValueError("budget must be at least 2, history at least 0")
    rows = only(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tokens", word_count(trimmed(F.col("text"))) + 1)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    opening = F.first(F.struct("role", "tokens")).over(order.rowsBetween(W.unboundedPreceding, 0))
    retained = (opening["role"] == "system") & (2 * opening["tokens"] <= budget)
    rows = rows.withColumn("room", budget - F.when(retained, opening["tokens"]).otherwise(0))
    rows = rows.withColumn("width", F.col("room") - F.least(F.lit(history), F.floor(F.col("room") / 2)))
    cell = F.floor(F.col("before") / F.col("width"))
    crosses = cell < F.floor((F.col("before") + F.col("tokens") - 1) / F.col("width"))
    rows = rows.withColumn("span", 2 * cell + crosses.cast("long"))
    head = F.concat(F.lit(BEGIN), _role(F.col("role")), F.lit(ROLE_END))
    body = escaped(F.col("text"))
    rows = rows.select("conv_id", "span", "rn", "before", "tokens", "room", "width", F.col("role").alias("role"), F.concat(head, body, F.lit(END)).alias("piece"), F.char_length(head).alias("at"), F.char_length(body).alias("length"))
    rows = stored(rows)
    piece = F.struct("rn", "piece", "at", "length", "tokens", (F.col("role") == "assistant").alias("learned"))
    spans = rows.groupBy("conv_id", "span").agg(F.min("before").alias("start"), F.min("rn").alias("first"), F.sum("tokens").alias("new"), F.max("room").alias("room"), F.max("width").alias("width"), F.sort_array(F.collect_list(piece)).alias("own"))
    # history: turns of the spans that can reach back far enough; an equi join on span numbers
    since = F.greatest(F.lit(0), F.col("start") - F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("new"))))
    reach = spans.withColumn("since", since).select("conv_id", F.col("span").alias("to"), "since", "first", F.explode(F.sequence(2 * F.floor(F.col("since") / F.col("width")), F.col("span"))).alias("span"))
    back = _joined(rows, reach, ["conv_id", "span"]).filter((F.col("rn") < F.col("first")) & (F.col("before") >= F.col("since")))
    back = back.groupBy("conv_id", "to").agg(F.sort_array(F.collect_list(piece)).alias("past")).withColumnRenamed("to", "span")
    # the system turn, where the conversation begins with one that leaves room
    system = rows.filter((F.col("rn") == 1) & (F.col("room") < budget)).select("conv_id", piece.alias("system"))
    whole = _joined(_joined(spans, back, ["conv_id", "span"], "left"), system, ["conv_id"], "left")
    none = F.array().cast(spans.schema["own"].dataType)
    past = F.coalesce("past", none)
    missing = F.col("system").isNotNull() & (F.col("first") > 1) & ~F.exists(past, lambda p: p["rn"] == 1)
    repeated = F.concat(F.when(missing, F.array("system")).otherwise(none), past)
    whole = whole.select("conv_id", "span", F.size(repeated).alias("n_repeated"), F.concat(repeated, "own").alias("_all"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    loss = F.aggregate(F.sequence(F.lit(1), F.size("_all")), start, lambda acc, k: F.struct(
        (acc["at"] + F.char_length(F.get(F.col("_all"), k - 1)["piece"])).alias("at"),
        F.when((k > F.col("n_repeated")) & F.get(F.col("_all"), k - 1)["learned"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.get(F.col("_all"), k - 1)["at"]).alias("start"), F.get(F.col("_all"), k - 1)["length"].alias("length"))))).otherwise(acc["loss"]).alias("loss"),
    ), lambda acc: acc["loss"])
    return whole.select(
        "conv_id", F.col("span").alias("window"), F.concat_ws("", F.transform("_all", lambda p: p["piece"])).alias("text"), "n_repeated", loss.alias("loss"),
        F.aggregate("_all", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
    )


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null conversation meets the null one."""
    for k in keys:
        b = b.withColumnRenamed(k, f"_{k}")
    on = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    test = on[0]
    for more in on[1:]:
        test = test & more
    return a.join(b, test, how).drop(*[f"_{k}" for k in keys])


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns (role, line feed, text, line feed per turn), loss (all learned text),
    formatted_chars: parsed from the windows' text and loss spans alone."""
    pieces = F.slice(F.split("text", BEGIN, -1), F.lit(2) + F.col("n_repeated"), F.size(F.split("text", BEGIN, -1)))
    each = F.transform(pieces, lambda p: F.concat(
        _role_back(F.substring_index(p, ROLE_END, 1)), F.lit("\n"),
        unescaped(F.substr(p, F.char_length(F.substring_index(p, ROLE_END, 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, ROLE_END, 1)) - 1 - len(END))), F.lit("\n"),
    ))
    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    rows = formatted.select("conv_id", "window", F.size(pieces).cast("long").alias("n"), F.concat_ws("", each).alias("turns"), F.concat_ws("", learned).alias("loss"), F.char_length("text").cast("long").alias("chars"))
    in_order = lambda c: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda x: x[c]))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), in_order("turns").alias("turns"), in_order("loss").alias("loss"), F.sum("chars").alias("formatted_chars"))
