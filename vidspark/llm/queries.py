"""Registered queries of the operators, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm import chat, content_sort, language_id, mixing, packing, personal_data, quality_rules, resampling, sentence_pieces, simhash, substrings, suffix_tree, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: DuckDB: words of a text.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules_sql() -> str:
    parts = [f"{m} {op} {v}" for _, m, low, high in quality_rules.RULES for op, v in ((">=", low), ("<=", high)) if v is not None]
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, g := w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM d),
again AS (SELECT doc_id, s.i AS i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, s.g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS c FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words, len(lines) AS nl,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS ns, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS nt,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS nb, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ne
    FROM d LEFT JOIN cov ON cov.doc_id IS NOT DISTINCT FROM d.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN ns / n_words ELSE 0 END AS stop_ratio, CASE WHEN n_words > 0 THEN nt / n_words ELSE 0 END AS letter_ratio,
    CASE WHEN nl > 0 THEN n_dup_lines / nl ELSE 0 END AS dup_line_ratio, CASE WHEN nl > 0 THEN nb / nl ELSE 0 END AS bullet_ratio, CASE WHEN nl > 0 THEN ne / nl ELSE 0 END AS ellipsis_ratio,
    n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM r"""


@register("op10_quality_rules", QUALITY_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op3_content_sort", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""")
def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.decisions(table(spark, sf_dir, "documents"))


@register("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


#: The recursion takes, in order, what fits into the rest of its source and drops what no longer does.
MIX_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
z AS (SELECT *, floor(sqrt(size::DOUBLE) * 1024)::BIGINT AS r, (('0x' || md5(k)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
s1 AS (SELECT source, sum(size)::BIGINT AS ss, sum(r * size) AS moment, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w FROM z GROUP BY source),
s2 AS (SELECT *, ss * 2.0::DOUBLE AS cap, (sum(ss) OVER () * 1.5::DOUBLE - coalesce(sum(ss * 2.0::DOUBLE) OVER (ORDER BY ss * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ss * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT *, coalesce(least(cap, w * max(CASE WHEN lv < cap / w THEN lv END) OVER ()), cap) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS c FROM s3),
s5 AS (SELECT *, target - c * ss AS rest, moment::DOUBLE / nullif(ss, 0) AS mean FROM s4),
q1 AS (SELECT z.*, s5.ss, s5.target, s5.c, s5.rest, rest / ss * r::DOUBLE / mean AS pi FROM z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source),
q2 AS (SELECT *, CASE WHEN size > 0 AND rest > 0 THEN CASE WHEN pi >= 1 THEN u - 1 ELSE (u / (1 - u)) / (pi / (1 - pi)) END END AS q FROM q1),
units AS (SELECT source, q, k, size, sum(size)::BIGINT AS words, any_value(rest) AS l FROM q2 WHERE q IS NOT NULL GROUP BY source, q, k, size),
walk AS (SELECT source, q, k, size, words, l, 0 AS state FROM units
    UNION ALL SELECT source, q, k, size, words, l2, CASE WHEN upto <= l THEN 1 ELSE 0 END FROM (
        SELECT *, l - coalesce(max(CASE WHEN upto <= l THEN upto END) OVER (PARTITION BY source), 0) AS l2 FROM (
            SELECT *, sum(words) OVER (PARTITION BY source ORDER BY q, k, size) AS upto FROM walk WHERE state = 0 AND words <= l))
    WHERE upto <= l OR words <= l2),
head AS (SELECT source, q, k, size, words FROM walk WHERE state = 1),
gap AS (SELECT source, any_value(l) - coalesce(any_value(t), 0) AS l FROM units LEFT JOIN (SELECT source AS hs, sum(words) AS t FROM head GROUP BY source) ON hs IS NOT DISTINCT FROM source GROUP BY source),
more AS (SELECT u.source, u.q, u.k, u.size FROM units u JOIN gap g ON u.source IS NOT DISTINCT FROM g.source
    WHERE u.size > g.l AND u.size - g.l < g.l AND NOT EXISTS (SELECT 1 FROM head h WHERE h.source IS NOT DISTINCT FROM u.source AND h.q = u.q AND h.k = u.k AND h.size = u.size)
    QUALIFY row_number() OVER (PARTITION BY u.source ORDER BY u.size, u.q, u.k) = 1),
extra AS (SELECT source AS es, q AS eq, k AS ek, size AS ez FROM head UNION SELECT source, q, k, size FROM more)
SELECT doc_id, size, ss AS source_size, target, CASE WHEN size > 0 THEN size * (c + (ez IS NOT NULL)::BIGINT) ELSE 0 END::BIGINT AS taken
FROM q2 LEFT JOIN extra ON es IS NOT DISTINCT FROM source AND eq = q AND ek = k AND ez = size"""


@register("op1_pareto_mix", MIX_SQL)
def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0).drop("copies")


def word_tokenizer() -> str:
    """The public vocabulary file the packing queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op5_bin_completion")
def op5_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end=1)


@register("op6_de_bruijn", rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM p QUALIFY min(doc_id) OVER (PARTITION BY md5(g)) < doc_id),
cov AS (SELECT doc_id, list(DISTINCT i + o) AS c FROM hit, (SELECT unnest(range(0, 50)) AS o) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(c), 0) AS r, CASE WHEN c IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(c, x))), lambda x: w[x]) END AS kept
    FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def op6_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), window=50)


@register("op7_suffix_tree")
def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"), folds=7, fold=2)


@register("op4_word_backoff")
def op4_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"), folds=4, fold=2)


@register("op2_bootstrapped_contexts")
def op2_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_spans(table(spark, sf_dir, "documents"))


@register("op9_budgeted_windows", r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
k AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tok, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]))', '\1\\\2\3', 'g')) + length(role) + 9 AS n FROM c),
t0 AS (SELECT *, row_number() OVER o AS rn, (sum(tok) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) - tok)::BIGINT AS b,
    1536 - first_value(CASE WHEN role = 'system' AND 2 * tok <= 1536 THEN tok ELSE 0 END) OVER o AS room FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
t1 AS (SELECT *, room - least(512, room // 2) AS width FROM t0),
t AS (SELECT *, 2 * (b // width) + CASE WHEN b // width < (b + tok - 1) // width THEN 1 ELSE 0 END AS span FROM t1),
s AS (SELECT conv_id, span, min(b) AS b0, min(rn) AS r0, least(512, greatest(0, any_value(room) - sum(tok))) AS h FROM t GROUP BY conv_id, span),
again AS (SELECT t.conv_id, sum(t.n) AS n FROM t JOIN s ON t.conv_id = s.conv_id AND t.rn < s.r0 AND (t.b >= s.b0 - s.h OR (t.rn = 1 AND t.room < 1536)) GROUP BY t.conv_id)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(t.n) + coalesce(any_value(again.n), 0))::BIGINT AS formatted_chars FROM t LEFT JOIN again ON again.conv_id = t.conv_id GROUP BY t.conv_id""")
def op9_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    formatted = chat.windows(turns.unionByName(spark.createDataFrame(hard, turns.schema)), budget=1536, history=512)
    back = chat.read_back(formatted)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return back.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")


#: DuckDB: bucket of a feature by its CRC-32, byte by byte through the table of the reflected polynomial.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
RESAMPLE_SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: {_CRC_STEP}) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS k, doc_id, w, len(w) AS nw FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d) GROUP BY k, g),
fb AS (SELECT g, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM b) GROUP BY g),
g AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(g) + 1), lambda i: ('0x' || hex(encode(g))[2 * i - 1:2 * i])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT g FROM fd UNION SELECT g FROM fb), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM fd JOIN g USING (g) GROUP BY bucket), t AS (SELECT bucket, sum(n)::BIGINT AS n FROM fb JOIN g USING (g) GROUP BY bucket),
gains AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM range(10000) AS r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM fd JOIN g USING (g) JOIN gains USING (bucket) GROUP BY k),
sc AS (SELECT doc_id, nw, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY nw >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, count(*) FILTER (nw >= 20) OVER () AS n FROM sc)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN nw >= 20 AND rank <= 25 * n // 100 THEN rank END AS rank FROM r"""


@register("op12_radix_resampling", RESAMPLE_SQL)
def op12_radix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=25, least=20).drop("n_words")


def piece_model() -> str:
    """The public vocabulary file of the piece queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register("op13_prefix_table")
def op13_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encoded(table(spark, sf_dir, "documents"), piece_model(), as_bytes=True, with_text=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def _rounds_sql(rounds: int) -> str:
    """Each round: nearest entry of every distinct part, then floored means. e0 are the first vectors."""
    out = []
    for k in range(rounds + 1):
        out.append(
            f"n{k} AS (SELECT u.pos, u.part, any_value(u.n) AS n, min(list_sum(list_transform(list_zip(u.part, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e.e) AS best FROM u JOIN e{k} e ON e.pos = u.pos GROUP BY u.pos, u.part)"
        )
        if k < rounds:
            out.append(f"s{k} AS (SELECT pos, best % 64 AS e, sum(n)::BIGINT AS n, {', '.join(f'sum(n * part[{i}])::BIGINT AS s{i}' for i in range(1, 5))} FROM n{k} GROUP BY pos, best % 64)")
            means = ", ".join(f"(s{i} - ((s{i} % s{k}.n + s{k}.n) % s{k}.n)) // s{k}.n" for i in range(1, 5))
            out.append(f"e{k + 1} AS (SELECT e.pos, e.e, CASE WHEN s{k}.n IS NULL THEN e.c ELSE [{means}] END AS c FROM e{k} e LEFT JOIN s{k} ON s{k}.pos = e.pos AND s{k}.e = e.e)")
    return ",\n".join(out)


CODES_SQL = rf"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT k, pos, q[4 * pos + 1:4 * pos + 4] AS part FROM v, range(16) AS r(pos)), u AS (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
e0 AS (SELECT p.pos, x.e, p.part AS c FROM p JOIN (SELECT k, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 64) x USING (k)),
{_rounds_sql(vector_codes.ROUNDS)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS h FROM e{vector_codes.ROUNDS}),
coded AS (SELECT k, string_agg(printf('%02x', best % 64), '' ORDER BY pos) AS code, sum(best // 64)::BIGINT AS error FROM p JOIN n{vector_codes.ROUNDS} USING (pos, part) GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN coded USING (k), books"""


@register("op11_part_trie", CODES_SQL)
def op11_part_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    code = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return codes.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))
