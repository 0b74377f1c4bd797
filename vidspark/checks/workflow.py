"""Benchmarks, queue, admission and table changes."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.operators import workflow as WF
from vidspark.sources import tables as ST

RIGHT = "recognized AND found IS NOT NULL AND (contains(replace(lower(person), '_', ' '), replace(lower(found), '_', ' ')) OR contains(replace(lower(found), '_', ' '), replace(lower(person), '_', ' ')))"
SCORES = """b AS (SELECT person, count(*) AS images, count(*) FILTER (ok) AS correct, count(*) FILTER (recognized AND NOT ok) AS wrong, count(*) FILTER (NOT recognized) AS not_recognized FROM (SELECT *, """ + RIGHT + """ AS ok FROM bench_rows) x GROUP BY 1),
    s AS (SELECT *, round(correct / images * 100, 2) AS score FROM b), scored AS (SELECT *, CASE WHEN score < 30 OR wrong >= 5 THEN 'high' WHEN score < 50 OR wrong >= 3 THEN 'medium' WHEN score < 80 THEN 'low' ELSE 'none' END AS priority FROM s)"""


@query("benchmark_scores", f"WITH {SCORES} SELECT *, priority <> 'none' AS needs_training FROM scored", ("bench_rows",))
def benchmark_scores(spark, sf):
    return WF.benchmark_scores(view(spark, sf, "bench_rows"), person="person", found="found")


@query("benchmark_and_queue", f"WITH {SCORES} SELECT person, priority, 'benchmark' AS source, score FROM scored WHERE priority <> 'none'", ("bench_rows",))
def benchmark_and_queue(spark, sf):
    return WF.benchmark_and_queue(view(spark, sf, "bench_rows"), person="person", found="found")


@query("weakest_persons", f"WITH {SCORES} SELECT person, score, priority FROM scored WHERE score < 70", ("bench_rows",))
def weakest_persons(spark, sf):
    return WF.weakest(WF.benchmark_scores(view(spark, sf, "bench_rows"), person="person", found="found"), below=70).select("person", "score", "priority")


@query("degraded_scores", """SELECT event_id, person, round(score, 2) AS score, round(p, 2) AS prev_score, coalesce(score < p - 10, false) AS degraded FROM (SELECT *, lag(score) OVER (PARTITION BY person ORDER BY event_id) AS p FROM queue_events) x""", ("queue_events",))
def degraded_scores(spark, sf):
    return WF.degraded(view(spark, sf, "queue_events").select("event_id", "person", "score"), person="person", ts="event_id", score="score").select("event_id", "person", "score", "prev_score", "degraded")


@query("last_runs", "SELECT person, event_id, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_id DESC) AS rn FROM queue_events) x WHERE rn <= 10", ("queue_events",))
def last_runs(spark, sf):
    return WF.last_runs(view(spark, sf, "queue_events"), person="person", ts="event_id").select("person", "event_id", F.col("rank").cast("long").alias("rank"))


@query("latest_per_key", "SELECT person, max(event_id) AS event_id, arg_max(action, event_id) AS action, arg_max(score, event_id) AS score FROM queue_events GROUP BY 1", ("queue_events",))
def latest_per_key(spark, sf):
    from vidspark.operators.common import latest_per_key as op

    return op(view(spark, sf, "queue_events").select("person", "event_id", "action", "score"), ["person"], ["event_id"])


@query("sampled_keys", "SELECT DISTINCT person FROM queue_events ORDER BY md5('3/' || person), person LIMIT 100", ("queue_events",))
def sampled_keys(spark, sf):
    return WF.stable_sample(view(spark, sf, "queue_events"), key="person", n=100, seed=3)


Q = """q AS (SELECT event_id AS seq, ts, person, score, CASE action WHEN 'signup' THEN 'add' WHEN 'view' THEN 'add' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'finish' ELSE 'remove' END AS action,
    CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS pr, priority, event_id % 5 = 0 AS move_to_top, action AS source FROM queue_events)"""
STATE = Q + """, r AS (SELECT person, max(seq) FILTER (action IN ('remove', 'finish')) AS r FROM q GROUP BY 1), a AS (SELECT q.* FROM q JOIN r USING (person) WHERE action IN ('add', 'update') AND (r IS NULL OR seq > r)),
    f AS (SELECT person, min(seq) FILTER (action = 'add') AS a0 FROM a GROUP BY 1), b AS (SELECT a.* FROM a JOIN f USING (person) WHERE seq >= a0), u AS (SELECT person, max(seq) FILTER (action = 'update') AS u0 FROM b GROUP BY 1),
    state AS (SELECT person, CASE min(pr) FILTER (u0 IS NULL OR seq >= u0) WHEN 0 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS priority, arg_min(source, seq) FILTER (action = 'add') AS source, arg_min(score, seq) FILTER (action = 'add') AS score,
        arg_min(ts, seq) FILTER (action = 'add') AS added_at, min(0) FILTER (action = 'update' AND move_to_top) AS "order" FROM b JOIN u USING (person) GROUP BY person)"""


def queue_rows(spark, sf):
    e = view(spark, sf, "queue_events")
    a = F.col("action")
    act = F.when(a.isin("signup", "view"), "add").when(a == "click", "update").when(a == "purchase", "finish").otherwise("remove")
    return e.select(F.col("event_id").alias("seq"), "ts", "person", "score", "priority", (F.col("event_id") % 5 == 0).alias("move_to_top"), a.alias("source"), act.alias("action"))


@query("queue_state", f"WITH {STATE} SELECT person, priority, source, score, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at, CAST(\"order\" AS BIGINT) AS manual_order FROM state", ("queue_events",))
def queue_state(spark, sf):
    s = WF.queue_state(queue_rows(spark, sf))
    return s.select("person", "priority", "source", "score", F.date_format("added_at", "yyyy-MM-dd HH:mm:ss").alias("added_at"), F.col("order").cast("long").alias("manual_order"))


@query("queue_order", f"WITH {STATE} SELECT person, priority, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, coalesce(\"order\", 999999), added_at, person) AS position FROM state", ("queue_events",))
def queue_order(spark, sf):
    return WF.queue_order(WF.queue_state(queue_rows(spark, sf))).select("person", "priority", "position")


@query("queue_raise", "SELECT person, CASE min(CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END) WHEN 0 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS priority, arg_min(action, event_id) AS action, arg_min(score, event_id) AS score FROM queue_events GROUP BY 1", ("queue_events",))
def queue_raise(spark, sf):
    e = view(spark, sf, "queue_events").select("person", "priority", "action", "score", F.col("event_id").alias("seq"))
    return WF.raise_priority(e)


AS_OF = "2024-01-31 00:00:00"


@query("due_queue", f"WITH {STATE} SELECT person, priority FROM state WHERE person NOT IN (SELECT person FROM queue_events WHERE action = 'purchase' AND floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400) < 7)", ("queue_events",))
def due_queue(spark, sf):
    history = view(spark, sf, "queue_events").filter("action = 'purchase'")
    return WF.due_queue(WF.queue_state(queue_rows(spark, sf)), history, as_of=F.lit(AS_OF).cast("timestamp_ntz")).select("person", "priority")


@query("not_benchmarked", f"SELECT DISTINCT person FROM queue_events WHERE person NOT IN (SELECT person FROM queue_events WHERE action = 'view' AND (epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 3600 < 24)", ("queue_events",))
def not_benchmarked(spark, sf):
    e = view(spark, sf, "queue_events")
    return WF.not_benchmarked_since(e.select("person").distinct(), e.filter("action = 'view'"), as_of=F.lit(AS_OF).cast("timestamp_ntz"))


@query("approvals", "SELECT person, event_id FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY event_id DESC) AS rn FROM queue_events WHERE action IN ('view', 'click')) x WHERE rn = 1 AND action = 'view'", ("queue_events",))
def approvals(spark, sf):
    e = view(spark, sf, "queue_events").filter("action IN ('view', 'click')").select("person", "event_id", "action")
    return WF.latest_flags(e, keys=["person"], seq="event_id", on=F.col("action") == "view").select("person", "event_id")


@query("approved_trained", "SELECT DISTINCT replace(person, ' ', '_') AS person FROM queue_events WHERE action = 'purchase' INTERSECT SELECT replace(person, ' ', '_') FROM queue_events WHERE action = 'signup' AND score > 20", ("queue_events",))
def approved_trained(spark, sf):
    e = view(spark, sf, "queue_events")
    trained = e.filter("action = 'purchase'").select(F.translate("person", " ", "_").alias("person")).distinct()
    return WF.approved_only(trained, e.filter("action = 'signup' AND score > 20"), person="person")


@query("open_checkpoints", "SELECT person, seq, stage FROM (SELECT person, event_id AS seq, CASE action WHEN 'purchase' THEN 'completed' ELSE action END AS stage, row_number() OVER (PARTITION BY person ORDER BY event_id DESC) AS rn FROM queue_events) x WHERE rn = 1 AND stage <> 'completed'", ("queue_events",))
def open_checkpoints(spark, sf):
    e = view(spark, sf, "queue_events").select("person", F.col("event_id").alias("seq"), F.when(F.col("action") == "purchase", "completed").otherwise(F.col("action")).alias("stage"))
    return WF.open_checkpoints(e, key="person", seq="seq")


@query("session_state", """SELECT person AS session, count(*) FILTER (a = 'append') AS total, count(*) FILTER (a = 'append' AND score > 20) AS successes, count(*) FILTER (a = 'append' AND NOT score > 20) AS failures,
    arg_max(label, event_id) FILTER (a IN ('create', 'rename')) AS name, bool_or(a = 'complete') AS is_complete, min(event_id) AS first_event
    FROM (SELECT *, CASE action WHEN 'signup' THEN 'create' WHEN 'error' THEN 'rename' WHEN 'purchase' THEN 'complete' ELSE 'append' END AS a, 'run ' || event_id AS label FROM queue_events) x GROUP BY 1""", ("queue_events",))
def session_state(spark, sf):
    a = F.col("action")
    e = view(spark, sf, "queue_events").select(F.col("person").alias("session"), "event_id", F.when(a == "signup", "create").when(a == "error", "rename").when(a == "purchase", "complete").otherwise("append").alias("action"),
                                               (F.col("score") > 20).alias("success"), F.concat(F.lit("run "), F.col("event_id")).alias("label"))
    return WF.session_state(e, session="session", seq="event_id")


@query("admit_capped", """WITH f AS (SELECT DISTINCT 'P' || l_partkey % 60 AS person, strftime(DATE '2024-01-01' + CAST(l_suppkey % 30 AS INTEGER), '%Y-%m-%d') AS day,
        concat_ws('_', 'f', lpad(CAST((l_partkey * 7919 + l_suppkey * 104729) % 1000000 AS VARCHAR), 6, '0'), l_orderkey, l_linenumber, l_suppkey, l_partkey) AS filename, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
    o AS (SELECT * FROM f WHERE flag = 'A' AND person > 'P3'), n AS (SELECT * FROM f WHERE NOT (flag = 'A' AND person > 'P3')), od AS (SELECT person, day, count(*) AS c FROM o GROUP BY ALL), ot AS (SELECT person, count(*) AS c FROM o GROUP BY ALL),
    d AS (SELECT n.*, row_number() OVER (PARTITION BY n.person, n.day ORDER BY filename DESC) + coalesce(od.c, 0) <= 3 AS dok, coalesce(ot.c, 0) AS t FROM n LEFT JOIN od USING (person, day) LEFT JOIN ot USING (person)),
    r AS (SELECT *, t + coalesce(count(*) FILTER (dok) OVER (PARTITION BY person ORDER BY filename DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
    SELECT filename, person, day, dok AND before < 40 AS admitted, CASE WHEN dok AND before < 40 THEN NULL WHEN before >= 40 THEN 'person_limit' ELSE 'daily_limit' END AS reason FROM r""")
def admit_capped(spark, sf):
    li = table(spark, sf, "lineitem")
    hashed = F.lpad(((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1000000).cast("string"), 6, "0")
    files = li.select(F.concat(F.lit("P"), F.col("l_partkey") % 60).alias("person"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_suppkey") % 30).cast("int")), "yyyy-MM-dd").alias("day"),
                      F.concat_ws("_", F.lit("f"), hashed, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("filename"), "l_returnflag")
    files = files.groupBy("person", "day", "filename").agg(F.min("l_returnflag").alias("flag"))
    old, new = files.filter("flag = 'A' AND person > 'P3'"), files.filter("NOT (flag = 'A' AND person > 'P3')")
    return WF.admit_capped(new, old.drop("flag")).select("filename", "person", "day", "admitted", "reason")


@query("admit_capped_day", """WITH f AS (SELECT DISTINCT 'c' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS person, strftime(o_orderdate, '%Y') AS day, 'f_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS filename FROM orders),
    d AS (SELECT *, row_number() OVER (PARTITION BY person, day ORDER BY filename DESC) AS dn FROM f), t AS (SELECT *, count(*) FILTER (dn <= 3) OVER (PARTITION BY person ORDER BY filename DESC) AS n FROM d)
    SELECT filename, person, day, dn <= 3 AND n <= 8 AS admitted, CASE WHEN dn <= 3 AND n <= 8 THEN NULL WHEN n - (CASE WHEN dn <= 3 THEN 1 ELSE 0 END) >= 8 THEN 'person_limit' ELSE 'daily_limit' END AS reason FROM t""")
def admit_capped_day(spark, sf):
    from vidspark.params import Admission

    o = table(spark, sf, "orders")
    f = o.select(F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("person"), F.date_format("o_orderdate", "yyyy").alias("day"), F.concat(F.lit("f_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("filename"))
    return WF.admit_capped(f, f.filter("false"), limits=Admission(per_person=8, per_day=3)).select("filename", "person", "day", "admitted", "reason")


@query("stop_at_target", """WITH c AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_returnflag = 'A' AND l_suppkey > 2 AS ok, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS n FROM lineitem),
    t AS (SELECT *, CASE WHEN n <= 50 THEN 0 ELSE CAST(ceil((n - 50) / 30) AS BIGINT) END AS chunk, 5 + coalesce(sum(CAST(ok AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE n <= 170),
    dry AS (SELECT l_suppkey, min(chunk) AS dry FROM (SELECT l_suppkey, chunk FROM t GROUP BY ALL HAVING count(*) FILTER (ok) = 0) z GROUP BY 1)
    SELECT l_suppkey, n AS seq, ok, CAST(before + CAST(ok AS BIGINT) AS BIGINT) AS accepted_so_far FROM t LEFT JOIN dry USING (l_suppkey) WHERE before < 40 AND (dry IS NULL OR chunk <= dry)""")
def stop_at_target(spark, sf):
    from vidspark.operators.common import numbered

    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", ((F.col("l_returnflag") == "A") & (F.col("l_suppkey") > 2)).alias("ok"))
    seq = numbered(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"], name="seq")
    return WF.stop_at_target(seq, group="l_suppkey", seq="seq", accepted="ok", already=5).select("l_suppkey", "seq", "ok", "accepted_so_far")


@query("upsert_coalesce", """WITH s AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, CAST(NULL AS VARCHAR) AS note FROM customer),
    c AS (SELECT o_custkey AS k, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, arg_max(seg, seq) FILTER (seg IS NOT NULL) AS seg, arg_max(note, seq) FILTER (note IS NOT NULL) AS note
        FROM (SELECT o_custkey, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'n' || o_orderkey END AS name, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS seg, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus END AS note FROM orders) x GROUP BY 1)
    SELECT k, coalesce(c.name, s.name) AS name, coalesce(c.seg, s.seg) AS seg, coalesce(c.note, s.note) AS note FROM s FULL OUTER JOIN c USING (k)""")
def upsert_coalesce(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"), F.lit(None).cast("string").alias("note"))
    o = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), o.alias("seq"), F.when(o % 5 == 0, F.concat(F.lit("n"), o)).alias("name"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("seg"), F.when(o % 3 == 1, F.col("o_orderstatus")).alias("note"))
    return WF.upsert(s, c, keys=["k"], order="seq")


@query("upsert_last", """SELECT k, arg_max(price, seq) AS price, arg_max(status, seq) AS status FROM (SELECT c_custkey AS k, c_acctbal AS price, 'old' AS status, -1 AS seq FROM customer UNION ALL SELECT o_custkey, o_totalprice, o_orderstatus, o_orderkey FROM orders) x GROUP BY 1""")
def upsert_last(spark, sf):
    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("price"), F.lit("old").alias("status"))
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("seq"))
    return WF.upsert(s, c, keys=["k"], mode="last", order="seq")


@query("delete_cascade", """SELECT 'person' AS kind, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS check_sum FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) a
    UNION ALL SELECT 'vector', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def delete_cascade(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    doomed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("person_id"))
    p, v = WF.delete_cascade(o.select("person_id").distinct(), o, doomed, key="person_id")
    a = p.agg(F.lit("person").alias("kind"), F.count("*").alias("n"), F.sum("person_id").alias("check_sum"))
    return a.unionByName(v.agg(F.lit("vector").alias("kind"), F.count("*").alias("n"), F.sum("o_orderkey").alias("check_sum")))


DEC = """d AS (SELECT c_custkey AS s, CASE WHEN c_acctbal < 2000 THEN 'MERGE' WHEN c_acctbal < 3000 THEN 'RENAME' WHEN c_acctbal < 3500 THEN 'DELETE' ELSE 'SKIP' END AS action, CAST(floor(c_custkey / 3) AS BIGINT) AS t FROM customer WHERE c_custkey <> floor(c_custkey / 3)),
    m AS (SELECT s, t FROM d WHERE action = 'MERGE'), r AS (SELECT s, t, 1 AS n FROM m UNION ALL SELECT r.s, m.t, n + 1 FROM r JOIN m ON r.t = m.s), f AS (SELECT s, arg_max(t, n) AS t FROM r GROUP BY s)"""


def decisions(spark, sf):
    b = F.col("c_acctbal")
    c = table(spark, sf, "customer").filter("c_custkey <> floor(c_custkey / 3)")
    return c.select(F.col("c_custkey").alias("source_id"), F.when(b < 2000, "MERGE").when(b < 3000, "RENAME").when(b < 3500, "DELETE").otherwise("SKIP").alias("action"), F.floor(F.col("c_custkey") / 3).alias("target_id"), F.concat(F.lit("new "), "c_name").alias("new_name"))


@query("apply_decisions_persons", f"WITH RECURSIVE {DEC} SELECT c_custkey AS person_id, CASE WHEN d.action = 'RENAME' THEN 'new ' || c_name ELSE c_name END AS name FROM customer LEFT JOIN d ON d.s = c_custkey WHERE c_custkey NOT IN (SELECT s FROM f) AND coalesce(d.action, '') <> 'DELETE'")
def apply_decisions_persons(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    vectors = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    return WF.apply_decisions(people, vectors, decisions(spark, sf))[0].select("person_id", "name")


@query("apply_decisions_vectors", f"WITH RECURSIVE {DEC} SELECT o_orderkey, coalesce(f.t, o_custkey) AS person_id FROM orders LEFT JOIN f ON f.s = o_custkey WHERE coalesce(f.t, o_custkey) NOT IN (SELECT s FROM d WHERE action = 'DELETE')")
def apply_decisions_vectors(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    vectors = table(spark, sf, "orders").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    return WF.apply_decisions(people, vectors, decisions(spark, sf))[1].select("o_orderkey", "person_id")


@query("rename_prefix", """WITH f AS (SELECT DISTINCT 'p' || (l_suppkey % 9) AS person, 'p' || (l_suppkey % 9) || '_2024_' || (l_partkey % 500) AS path FROM lineitem), w AS (SELECT *, CASE WHEN person IN ('p1', 'p2', 'p3') THEN 'q' || substr(path, 3) WHEN person = 'p4' THEN 'p5' || substr(path, 3) END AS want FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY path) AS rn FROM w)
    SELECT path, CASE WHEN want IS NOT NULL AND rn = 1 AND want NOT IN (SELECT path FROM f) THEN want ELSE path END AS new_path FROM k""")
def rename_prefix(spark, sf):
    li = table(spark, sf, "lineitem")
    person = F.concat(F.lit("p"), F.col("l_suppkey") % 9)
    f = li.select(person.alias("person"), F.concat(person, F.lit("_2024_"), F.col("l_partkey") % 500).alias("path")).distinct()
    merges = f.select("person").distinct().filter("person IN ('p1', 'p2', 'p3', 'p4')").withColumn("target", F.when(F.col("person") == "p4", "p5").otherwise("q"))
    return WF.rename_prefix(f, merges, path="path", person="person").select("path", "new_path")


PROMO = """st AS (SELECT DISTINCT 'd' || o_custkey AS folder, 'img_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '.JPG' AS file, md5(CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS VARCHAR)) AS digest FROM orders WHERE o_orderstatus <> 'P'),
    pr AS (SELECT DISTINCT 'd' || o_custkey AS folder, md5(CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS VARCHAR)) AS digest FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT folder, count(*) AS images FROM st GROUP BY 1),
    fr AS (SELECT folder, digest, min(file) AS file FROM st JOIN n USING (folder) WHERE images >= 5 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.folder = st.folder AND pr.digest = st.digest) GROUP BY ALL)"""


def promo(spark, sf):
    o = table(spark, sf, "orders")
    dig = F.md5((F.floor("o_totalprice") % 40).cast("string").cast("binary"))
    rows = o.select("o_orderstatus", F.concat(F.lit("d"), F.col("o_custkey")).alias("folder"), F.concat(F.lit("img_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".JPG")).alias("file"), dig.alias("digest"))
    return WF.promote(rows.filter("o_orderstatus <> 'P'").drop("o_orderstatus"), rows.filter("o_orderstatus = 'P'").drop("o_orderstatus"), folder="folder", file="file", digest="digest", today="2024-02-01")


@query("promoted_files", f"WITH {PROMO} SELECT folder, file, folder || '_2024-02-01_' || lpad(CAST(row_number() OVER (PARTITION BY folder ORDER BY file) AS VARCHAR), 6, '0') || '.jpg' AS new_name FROM fr")
def promoted_files(spark, sf):
    return promo(spark, sf)[0].select("folder", "file", "new_name")


@query("promotion_report", f"WITH {PROMO}, c AS (SELECT folder, count(*) AS copied FROM fr GROUP BY 1) SELECT folder, images, coalesce(copied, 0) AS copied, CASE WHEN images < 5 THEN 'too_few_images' WHEN copied IS NULL THEN 'all_duplicates' ELSE 'deployed' END AS status, CASE WHEN images < 5 THEN 0 ELSE images - coalesce(copied, 0) END AS duplicates FROM n LEFT JOIN c USING (folder)")
def promotion_report(spark, sf):
    return promo(spark, sf)[1].select("folder", "images", "copied", "status", "duplicates")


@query("retention", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS bytes FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31' - 7 GROUP BY 1")
def retention(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("bytes"))
    return WF.retain(e, day="day", as_of="2024-01-31", size="bytes")[1]


@query("new_images", "SELECT DISTINCT filename FROM (SELECT 'f' || l_partkey || '_' || l_suppkey AS filename FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT 'f' || l_partkey || '_' || l_suppkey FROM lineitem WHERE l_returnflag <> 'N') x")
def new_images(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.concat(F.lit("f"), F.col("l_partkey"), F.lit("_"), F.col("l_suppkey")).alias("filename"))
    return li.filter("l_returnflag = 'N'").select("filename").subtract(li.filter("l_returnflag <> 'N'").select("filename"))


@query("gallery_load", "SELECT vec_id, 'person_' || person_id AS person FROM gallery WHERE domain = 'north' AND len(embedding) > 0", ("gallery",))
def gallery_load(spark, sf):
    return ST.gallery_rows(view(spark, sf, "gallery"), domain="north").select("vec_id", "person")


@query("bulk_insert_split", "SELECT CASE WHEN vec_id % 9 = 4 THEN 'no_vector' WHEN vec_id % 11 = 3 THEN 'wrong_dimension' ELSE 'inserted' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def bulk_insert_split(spark, sf):
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings").withColumn("embedding", F.when(v % 9 == 4, F.lit(None)).when(v % 11 == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")))
    good, bad = ST.split_valid(e, dim=64, keys=("vec_id",))
    return good.select(F.lit("inserted").alias("status")).unionByName(bad.select(F.col("reject_reason").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))


@query("backfill_persons", """WITH f AS (SELECT DISTINCT replace(full_name, ' ', '_') AS folder, domain FROM names), k AS (SELECT DISTINCT replace(full_name, ' ', '_') AS folder, domain FROM names WHERE name = full_name), mp AS (SELECT replace(full_name, ' ', '_') AS folder, max('Original ' || full_name) AS original FROM names WHERE domain = 'north' GROUP BY 1)
    SELECT f.folder, f.domain, coalesce(original, replace(f.folder, '_', ' ')) AS name FROM f LEFT JOIN mp USING (folder) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.folder = f.folder AND k.domain = f.domain)""", ("names",))
def backfill_persons(spark, sf):
    n = view(spark, sf, "names").withColumn("folder", F.translate("full_name", " ", "_"))
    known = n.filter("name = full_name").select("folder", "domain").distinct()
    name_map = n.filter("domain = 'north'").groupBy("folder").agg(F.max(F.concat(F.lit("Original "), "full_name")).alias("original"))
    return ST.backfill_persons(n, known, name_map)
