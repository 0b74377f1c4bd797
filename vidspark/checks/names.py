"""Names: normal forms, file-name rules, similarity, merge candidates."""

from pyspark.sql import functions as F

from vidspark.checks.registry import query
from vidspark.checks.views import table, view
from vidspark.functions import names as N
from vidspark.functions import scalars as S
from vidspark.operators import naming
from vidspark.operators.graph import connected_groups, resolve_merges


def _chain(col, pairs):
    for a, b in pairs:
        col = f"replace({col}, '{a}', '{b}')"
    return col


def _fold(col):
    return f"translate({_chain(col, N.LATIN_LONG)}, '{N.LATIN_FROM}', '{N.LATIN_TO}')"


def _ascii(col):
    return f"regexp_replace({_fold(col)}, '[^\\x00-\\x7F]', '', 'g')"


SAFE = f"regexp_replace(replace({_ascii(_chain('{c}', N.SPELLED_OUT))}, ' ', '_'), '[^A-Za-z0-9_-]', '', 'g')"
COMPARE = _chain("regexp_replace(regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g'), '\\s+(jr|sr|ii|iii|iv)\\.?$', '')", N.COMPARE_FOLD)
FILEFORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({f}, '[^\\x00-\\x7F]', '_', 'g'), '\\s+', '_', 'g'), '[/\\\\:*?\"<>|]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
WORDS = "SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents"
TOKENS = f"SELECT w FROM ({WORDS}) x WHERE w <> ''"


def words(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("w")).filter("w <> ''").distinct()


@query("name_forms", f"""SELECT person_id, {SAFE.replace('{c}', 'name')} AS safe, lower({SAFE.replace('{c}', 'name')}) AS safe_lower, replace(regexp_replace({_ascii('name')}, '[^A-Za-z0-9_\\s]', '', 'g'), ' ', '_') AS text_form,
    regexp_replace(regexp_replace({_ascii('name')}, '[^A-Za-z0-9_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS search_form, {COMPARE.replace('{c}', 'name')} AS compare_form, {FILEFORM.replace('{f}', _fold(_chain('name', N.FILE_FOLD)))} AS file_form,
    replace(name, '_', ' ') AS display, regexp_matches(name, '^\\p{{Ll}}') AS lower_start FROM names""", ("names",))
def name_forms(spark, sf):
    c = F.col("name")
    return view(spark, sf, "names").select("person_id", N.safe_name(c).alias("safe"), N.safe_name(c, lower=True).alias("safe_lower"), N.normalize_text(c).alias("text_form"), N.normalize_for_search(c).alias("search_form"),
                                           N.normalize_name(c).alias("compare_form"), N.normalize_person_name(c).alias("file_form"), N.display_name(c).alias("display"), N.starts_lowercase(c).alias("lower_start"))


@query("word_forms", f"""SELECT w, {SAFE.replace('{c}', 'w')} AS safe, regexp_replace({_ascii('w')}, '[^A-Za-z0-9_\\s]', '', 'g') AS text_form, {FILEFORM.replace('{f}', _fold(_chain('w', N.FILE_FOLD)))} AS file_form FROM ({TOKENS}) t""")
def word_forms(spark, sf):
    c = F.col("w")
    return words(spark, sf).select("w", N.safe_name(c).alias("safe"), N.normalize_text(c).alias("text_form"), N.normalize_person_name(c).alias("file_form"))


@query("safe_name_exact", f"SELECT w, {SAFE.replace('{c}', 'w')} AS safe FROM ({TOKENS}) t")
def safe_name_exact(spark, sf):
    """Every word of the documents; the decomposition is exact for any script."""
    return words(spark, sf).select("w", N.safe_name(F.col("w")).alias("safe"))


PARTS = "string_split(filename, '_')"
STOP_A = "(len(p) >= 8 AND regexp_matches(p, '^[0-9]{4}'))"
RULE = "list_position(list_transform({parts}, lambda p: {stop}), true)"


def _before(stop):
    pos = RULE.format(parts=PARTS, stop=stop)
    return f"array_to_string(CASE WHEN coalesce({pos}, 0) = 0 THEN {PARTS} ELSE {PARTS}[1:{pos} - 1] END, '_')"


@query("person_from_file", f"""SELECT file_id, {_before(STOP_A)} AS rule_a, {_before("(len(p) >= 8 AND (regexp_matches(p, '^[0-9]{4}') OR contains(p, '-')))")} AS rule_b,
    CASE WHEN coalesce({RULE.format(parts=PARTS, stop="(" + STOP_A + " OR contains(p, '-'))")}, 0) > 0 THEN {_before("(" + STOP_A + " OR contains(p, '-'))")} END AS rule_c,
    split_part({PARTS}[nullif({RULE.format(parts=PARTS, stop="(" + STOP_A + " OR contains(p, '-'))")}, 0)], '.', 1) AS rule_c_date,
    regexp_replace(regexp_replace(filename, '\\.[a-z]+$', ''), '_[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}.*$', '') AS rule_d, TRY_CAST(regexp_extract(filename, '_([0-9]+)\\.[a-z]+$', 1) AS BIGINT) AS seq FROM catalog_files""", ("catalog_files",))
def person_from_file(spark, sf):
    c = F.concat(F.lit("/data/"), F.col("domain"), F.lit("/"), F.col("filename"))
    return view(spark, sf, "catalog_files").select("file_id", *[N.person_from_path(c, r).alias(f"rule_{r}") for r in "abcd"], N.date_from_path(c).alias("rule_c_date"), N.sequence_number(c).alias("seq"))


@query("relabelled_files", f"""WITH x AS (SELECT file_id, filename, regexp_extract(filename, '_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}_[0-9]+)', 1) AS tail, 'Ana_' || replace(domain, 'e', 'e') AS person, regexp_extract(filename, '(\\.[a-z]+)$', 1) AS ext FROM catalog_files)
    SELECT file_id, person || '_' || CASE WHEN tail <> '' THEN tail ELSE '2024-01-01_1' END || ext AS new_name FROM x""", ("catalog_files",))
def relabelled_files(spark, sf):
    f = view(spark, sf, "catalog_files")
    person = F.concat(F.lit("Ana  "), "domain")
    return f.select("file_id", N.relabelled_file(F.col("filename"), person, F.lit("2024-01-01_1")).alias("new_name"))


@query("edit_similarity", """WITH n AS (SELECT person_id, translate(replace(lower(name), '_', ' '), 'šđ', '12') AS x, translate(replace(lower(full_name), '_', ' '), 'šđ', '12') AS y FROM names), t AS (SELECT person_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x, y FROM n)
    SELECT person_id, round(CASE WHEN x = y THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(len(x), len(y)) END, 6) AS similarity, contains(x, y) OR contains(y, x) AS same_person FROM t""", ("names",))
def edit_similarity(spark, sf):
    return view(spark, sf, "names").select("person_id", F.round(N.edit_similarity(F.col("name"), F.col("full_name")), 6).alias("similarity"), N.same_person(F.col("full_name"), F.col("name")).alias("same_person"))


SUSPICIOUS = """WITH n AS (SELECT person, found, min(event_id) AS first_event, replace(lower(person), '_', ' ') AS x, replace(lower(found), '_', ' ') AS y FROM bench_rows WHERE recognized AND found IS NOT NULL GROUP BY ALL),
    s AS (SELECT *, CASE WHEN x = y THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(len(x), len(y)) END AS sim FROM n WHERE NOT (contains(x, y) OR contains(y, x)))
    SELECT person, found, first_event, round(sim * 100, 1) AS similarity FROM s WHERE sim >= 0.3e0 AND sim < 0.95e0"""


@query("suspicious_labels", SUSPICIOUS, ("bench_rows",))
def suspicious_labels(spark, sf):
    from vidspark.operators.workflow import suspicious_labels as op

    return op(view(spark, sf, "bench_rows"), person="person", found="found", order="event_id", low=0.3).select("person", "found", F.col("order").alias("first_event"), "similarity")


@query("transcribed", f"""WITH t AS ({TOKENS}) SELECT w, CASE WHEN regexp_matches(w, '[{N.NATIVE_LETTERS}]') THEN true WHEN regexp_matches(lower(w), '({"|".join(N.NATIVE_ENDINGS)})$') THEN false
    ELSE regexp_matches(lower(w), '{"|".join(N.TRANSCRIBED_PARTS)}') OR regexp_matches(replace(lower(w), '_', ''), '^({"|".join(N.TRANSCRIBED_STARTS)})') OR regexp_matches(lower(w), '{"|".join(N.TRANSCRIBED_WORDS)}') END AS transcribed,
    CASE WHEN len(reverse(w) || w[1:3]) <= len(w) * 2 THEN reverse(w) || w[1:3] ELSE w END AS renamed FROM t""")
def transcribed(spark, sf):
    w = F.col("w")
    return words(spark, sf).select("w", N.looks_transcribed(w).alias("transcribed"), N.checked_rename(w, F.concat(F.reverse(w), F.substring(w, 1, 3))).alias("renamed"))


@query("names_in_text", """WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[.,!?:;"''-]+|[.,!?:;"''-]+$', '', 'g')) AS ws FROM documents),
    p AS (SELECT doc_id, unnest(list_zip(ws[:-2], ws[2:])) AS z FROM d WHERE len(ws) > 1),
    n AS (SELECT doc_id, z[1] || ' ' || z[2] AS name, z[1] AS a, z[2] AS b FROM p)
    SELECT lower(name) AS name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM n WHERE regexp_full_match(a, '\\p{Lu}\\p{L}+') AND regexp_full_match(b, '\\p{Lu}\\p{L}+')
      AND a NOT IN ('The', 'This', 'That', 'How', 'What', 'When', 'Where', 'Why') AND len(name) > 5 GROUP BY ALL""")
def names_in_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(N.name_pairs(F.col("text"))).alias("name"))
    return d.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))


@query("first_last_names", """SELECT DISTINCT full_name AS full, split_part(full_name, ' ', 1) AS first, substr(full_name, len(split_part(full_name, ' ', 1)) + 2) AS last FROM names WHERE full_name NOT LIKE 'Q%'""", ("names",))
def first_last_names(spark, sf):
    n = view(spark, sf, "names").select(F.col("full_name").alias("full")).distinct().withColumn("p", N.first_last(F.col("full"))).filter("p IS NOT NULL")
    return n.select("full", "p.first", "p.last")


@query("spreadsheet_names", """WITH e AS (SELECT DISTINCT replace(full_name, ' ', '') AS name, 'x' AS last_name FROM names), n AS (SELECT regexp_replace(replace(c_name, '#', ' '), '^\\s+|\\s+$', '', 'g') AS f FROM customer UNION ALL SELECT c_mktsegment FROM customer)
    SELECT * FROM e UNION ALL SELECT split_part(f, ' ', 1), substr(f, len(split_part(f, ' ', 1)) + 2) FROM n WHERE contains(f, ' ')""", ("names",))
def spreadsheet_names(spark, sf):
    from vidspark.sources.tables import append_names

    existing = view(spark, sf, "names").select(F.translate("full_name", " ", "").alias("name"), F.lit("x").alias("last_name")).distinct()
    c = table(spark, sf, "customer")
    new = c.select(F.translate("c_name", "#", " ").alias("full")).unionByName(c.select(F.col("c_mktsegment").alias("full")))
    return append_names(existing, new, full="full")


@query("clean_domains", """SELECT page_id, regexp_replace(split_part(url, ':', 1), '[<>:"/\\\\|?*]', '_', 'g') AS scheme, regexp_replace(split_part(substr(url, 9), ':', 1), '[<>:"/\\\\|?*]', '_', 'g') AS domain FROM pages""")
def clean_domains(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.clean_domain(F.col("url")).alias("scheme"), N.clean_domain(F.substr("url", F.lit(9))).alias("domain"))


@query("similar_names")
def similar_names(spark, sf):
    return naming.similar_names(view(spark, sf, "names"), threshold=90.0)


@query("same_names", f"""WITH n AS (SELECT DISTINCT name, {COMPARE.replace('{c}', 'name')} AS f FROM names) SELECT a.name AS source, b.name AS target, 100.0e0 AS similarity FROM n a JOIN n b ON a.f = b.f AND a.name <> b.name""", ("names",))
def same_names(spark, sf):
    """The part of the similar names that SQL can say: equal comparison forms. Each form is also written with capitals and in its file form."""
    return naming.similar_names(view(spark, sf, "names"), threshold=100.0)


VARIANTS = """WITH m AS (SELECT * FROM (VALUES (0, 'red', 'blue'), (1, 'small', 'large'), (2, 'ring', 'ring')) v(idx, l, i)), n AS (SELECT DISTINCT name FROM names),
    p AS (SELECT n.name, m.idx, 0 AS side, o.name AS target FROM n JOIN m ON contains(lower(n.name), m.l) JOIN n o ON contains(lower(o.name), m.i) AND o.name <> n.name
          UNION ALL SELECT n.name, m.idx, 1, o.name FROM n JOIN m ON contains(lower(n.name), m.i) JOIN n o ON contains(lower(o.name), m.l) AND o.name <> n.name)
    SELECT name AS source, target, CASE side WHEN 0 THEN 'local ' || l || ' vs ' || i ELSE 'international ' || i || ' vs ' || l END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY target, idx, side) AS rn FROM p) x JOIN m USING (idx) WHERE rn = 1"""


@query("spelling_variants", VARIANTS, ("names",))
def spelling_variants(spark, sf):
    return naming.spelling_variants(view(spark, sf, "names"), pairs=[("red", "blue"), ("small", "large"), ("ring", "ring")])


@query("nickname_matches")
def nickname_matches(spark, sf):
    n = view(spark, sf, "names").withColumn("name", N.display_name(F.col("name")))
    return naming.nickname_matches(n, nicknames=[("small", "large"), ("red", "blue")], surname_similarity=60.0)


NICK = """WITH p AS (SELECT DISTINCT replace(name, '_', ' ') AS name, string_split(lower(trim(replace(name, '_', ' '))), ' ') AS w FROM names), n AS (SELECT name, w[1] AS first, w[-1] AS last FROM p WHERE len(w) > 1)
    SELECT a.name AS source, min(b.name) AS target, arg_min(m.nick || ' is short for ' || m.whole, (b.name, m.nick, m.whole)) AS reason FROM n a JOIN (VALUES ('small', 'large'), ('red', 'blue')) m(nick, whole) ON m.nick = a.first JOIN n b ON b.first = m.whole AND b.last = a.last WHERE a.name <> b.name GROUP BY a.name"""


@query("nicknames_of_a_surname", NICK, ("names",))
def nicknames_of_a_surname(spark, sf):
    """Nickname and full name under one and the same last name."""
    n = view(spark, sf, "names").withColumn("name", N.display_name(F.col("name")))
    return naming.nickname_matches(n, nicknames=[("small", "large"), ("red", "blue")], surname_similarity=100.0)


@query("merge_candidates")
def merge_candidates(spark, sf):
    people = view(spark, sf, "names").groupBy("name").agg(F.min("person_id").alias("person_id"))
    return naming.in_report_order(naming.merge_candidates(people))


@query("linked_groups", """WITH RECURSIVE e AS (SELECT c_custkey AS a, abs(c_custkey - c_nationkey) AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
    r(id, root) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.root WHERE u.b < r.root OR true) SELECT id, min(root) AS root FROM r GROUP BY id""")
def linked_groups(spark, sf):
    c = table(spark, sf, "customer")
    return connected_groups(c.select(F.col("c_custkey").alias("a"), F.abs(F.col("c_custkey") - F.col("c_nationkey")).alias("b")), a="a", b="b")


@query("resolved_merges", """WITH RECURSIVE d AS (SELECT c_custkey AS s, CAST(floor(c_custkey / 3) AS BIGINT) AS t FROM customer WHERE c_custkey <> floor(c_custkey / 3)),
    r AS (SELECT s, t, 1 AS n FROM d UNION ALL SELECT r.s, d.t, n + 1 FROM r JOIN d ON r.t = d.s) SELECT s AS source_id, arg_max(t, n) AS target_id FROM r GROUP BY s""")
def resolved_merges(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.floor(F.col("c_custkey") / 3).alias("target_id")).filter("source_id <> target_id")
    return resolve_merges(d)


@query("dates_in_layouts", """WITH d AS (SELECT o_orderkey, o_orderdate AS t, o_orderkey % 6 AS k FROM orders) SELECT o_orderkey, CASE WHEN k < 5 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS parsed FROM d""")
def dates_in_layouts(spark, sf):
    o = table(spark, sf, "orders")
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = F.lit("soon")
    for i, f in enumerate(("yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy")):
        text = F.when(k == i, F.date_format(t, f)).otherwise(text)
    return o.select("o_orderkey", F.date_format(S.parse_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("relevance_scores", """SELECT c_custkey, 50 + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 15 ELSE 0 END + CASE c_custkey % 4 WHEN 0 THEN 25 WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 0 END
    + CASE WHEN c_nationkey = 0 THEN 0 ELSE greatest(0, 20 - c_nationkey * 2) END + CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END AS score FROM customer""")
def relevance_scores(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    src = F.when(k % 4 == 0, "google_trends").when(k % 4 == 1, "news").when(k % 4 == 2, "wikidata").otherwise("manual")
    return c.select("c_custkey", N.relevance(F.when(k % 3 == 0, F.concat(F.lit("Q"), k)), F.when(F.col("c_acctbal") > 0, "url"), src, F.col("c_nationkey"), F.when(F.col("c_mktsegment") == "BUILDING", "actor")).alias("score"))


@query("geo_and_bytes", """SELECT o_orderkey, round((o_custkey % 90 + (o_orderkey % 60) / 60.0e0 + (o_orderkey % 3600 / 60.0e0) / 3600.0e0) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END, 8) + 0.0 AS decimal_degrees,
    CASE WHEN b < 1024 THEN printf('%.2f B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824) ELSE printf('%.2f TB', b / 1099511627776) END AS bytes FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 100000000 END AS DOUBLE) AS b FROM orders) x""")
def geo_and_bytes(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    dms = F.array((F.col("o_custkey") % 90).cast("double"), (k % 60).cast("double"), k % 3600 / 60.0)
    size = F.floor("o_totalprice") * F.when(k % 4 == 0, 1).when(k % 4 == 1, 1000).when(k % 4 == 2, 1000000).otherwise(100000000)
    return o.select("o_orderkey", (F.round(S.dms_to_decimal(dms, F.when(k % 2 == 0, "N").otherwise("S")), 8) + 0.0).alias("decimal_degrees"), S.human_bytes(size).alias("bytes"))


@query("video_ids", """SELECT event_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS video_id FROM events""")
def video_ids(spark, sf):
    stem = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 12), F.lit(".mp4"))
    return table(spark, sf, "events").select("event_id", N.video_id(stem).alias("video_id"))


@query("suggested_names", f"""WITH k AS (SELECT {COMPARE.replace('{c}', 'name')} AS f, person_id FROM names), o AS (SELECT f, min(person_id) AS first_id, count(*) AS n FROM k GROUP BY f) SELECT n.person_id, coalesce(m.full_name, replace(n.name, '_', ' ')) AS display FROM names n LEFT JOIN (SELECT full_name, replace(full_name, ' ', '_') AS nm, min(person_id) AS pid FROM names GROUP BY ALL) m ON m.nm = n.name""", ("names",))
def suggested_names(spark, sf):
    """Lookup enrichment: normalised -> original name, default with spaces for underscores."""
    from vidspark.operators.workflow import enrich_names

    n = view(spark, sf, "names")
    mapping = n.groupBy("full_name").agg(F.min("person_id").alias("seq")).select(F.translate("full_name", " ", "_").alias("normalized"), F.col("full_name").alias("original"), "seq")
    return enrich_names(n, mapping, name="name", order="seq").select("person_id", "display")
