"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    packing,
    periodic_runs,
    quality,
    quotations,
    repair,
    sharding,
    simhash,
    toxicity,
    url_filter,
)
from wordloom.llm.expressions import let, words_of

URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(documents, _table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quotation_linking(spark, sf_dir):
    return quotations.linked_conversations(_table(spark, sf_dir, "conversations"))


def op3_line_dedup(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.repeated_lines(documents)
    return found.select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("bigint").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


def op4_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[name for name in quality.RESULTS if name != "clean_text"])


def op5_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_license_scan(spark, sf_dir):
    scanned = licenses.license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "licence", "dice", F.array_join("licences", ",").alias("licences"))


def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_sharding(spark, sf_dir):
    placed = sharding.shard(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return placed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = F.round(F.get("repeats", F.lit(0))["position"], 6).alias("position")
    target = F.round("target", 6).alias("target")
    # Documents that are not taken have no position and may be many; their ids spread them.
    order = [F.asc_nulls_last("position"), F.asc("doc_id")]
    return (
        mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", target, "taken", first)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


def op10_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("host_words", " ").alias("host_words"), "log_odds")


def op11_best_fit_packing(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(packing.tokenized(_table(spark, sf_dir, "documents"), tokenizer))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with rows dropped, emptied, cut short, repeated or given another role, by a checksum of each row's key."""

    def filled(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), harm.alias("harm"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations")
    repaired = repair.repair(damaged(conversations))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = conversations.select("conv_id").distinct().select(key.alias("key"), "conv_id")
    found = every.join(repaired.summary.drop("conv_id"), "key", "left").join(repair.digests(repaired.pieces), "key", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id",
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by a checksum of the id, the last words repeat with one period."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def planted(words):
        n, g = F.size(words), F.col("g")
        a = F.when(n > 0, g % n).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.array_join(repeated, " ")

    rows = documents.select("doc_id", "text", mark.alias("mark"), F.floor(mark / 10).alias("g"))
    text = F.when(F.col("mark") % 10 == 0, let(words_of(F.col("text")), planted)).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))

    def better(best, run):
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best["start"].isNull() | ahead, run).otherwise(best)

    no_run = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    none = F.struct(*[no_run[name].alias(name) for name in ("start", "length", "period")])
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.aggregate("runs", none, better)
    said = F.transform("runs", lambda run: F.concat_ws(",", *[run[name].cast("string") for name in ("start", "length", "period")]))
    lines = F.concat(F.array_join(said, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quotation_linking": op2_quotation_linking,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_license_scan": op6_license_scan,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_sharding": op8_sharding,
        "op9_mixing": op9_mixing,
        "op10_url_filter": op10_url_filter,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_periodic_runs": op13_periodic_runs,
    }


# --- the same in SQL --------------------------------------------------------------------------
# None for toxicity, quotation linking, line dedup, SimHash, sharding (checksums) and URLs: tests hold them to brute force.

_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
tokens AS (SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w0 FROM w),
led AS (
    SELECT rid, pos, w0, {", ".join(f"lead(w0, {i}) OVER o AS w{i}" for i in range(1, 5))}
    FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY pos)
),
twice AS (
    SELECT rid, pos, count(*) OVER (PARTITION BY rid, w0, w1, w2, w3, w4) AS n FROM led WHERE w4 IS NOT NULL
),
reach AS (
    SELECT rid, least(5, coalesce(lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos, 5)) AS reach FROM twice WHERE n > 1
),
repeated AS (SELECT rid, sum(reach)::BIGINT AS n_repeat_words FROM reach GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d),
judged AS (
    SELECT rid, l,
        NOT (regexp_matches(right(rtrim(l, {_BLANKS}), 1), {_quoted(quality.TERMINAL)}) OR regexp_matches(l, {_quoted(quality.SENTENCE_END)}))
        OR len(regexp_extract_all(l, '{quality.SEPARATORS}')) >= {quality.MAX_SEPARATORS}
        OR len(regexp_extract_all(l, '{quality.NOISE}')) * 100 > length(l) * {quality.MAX_NOISE_PERCENT}
        OR (length(l) <= {quality.MAX_BOILERPLATE_CHARS} AND regexp_matches(lower(l), '{quality.BOILERPLATE}')) AS fails,
        length(array_to_string(regexp_extract_all(l, '{_WORD}'), '')) AS chars
    FROM lines WHERE regexp_matches(l, '{_WORD}')
),
by_line AS (
    SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0)::BIGINT AS lost_chars
    FROM judged GROUP BY rid
),
counted AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost_chars, 0)::BIGINT AS lost_chars
    FROM w LEFT JOIN repeated USING (rid) LEFT JOIN by_line USING (rid)
),
based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {quality.MAX_LOST_PERCENT} AS kept FROM based"""


def _decontamination_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH items AS (SELECT item_id, {words} AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(len(ws), {decontaminate.WINDOW}) AS n FROM items WHERE len(ws) > 0),
windows AS (
    SELECT DISTINCT item_id, n, unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS win FROM sized
),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({words}, []) AS ws FROM documents),
cut AS (
    SELECT rid, n, [array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)] AS wins
    FROM d CROSS JOIN (SELECT DISTINCT n FROM windows)
),
opened AS (SELECT rid, n, generate_subscripts(wins, 1) AS begins, unnest(wins) AS win FROM cut),
met AS (SELECT rid, n, begins, item_id FROM opened JOIN windows USING (n, win)),
covered AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(begins, begins + n)) AS pos FROM met) GROUP BY rid),
named AS (
    SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
    FROM met GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""


def _license_sql() -> str:
    listed = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.TEMPLATES.items())

    def grams(text: str) -> str:
        return f"[lower(x) FOR x IN regexp_extract_all({text}, '[A-Za-z0-9]+')]"

    pairs = "list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])"
    return f"""
WITH t AS (SELECT name, {pairs} AS tb FROM (SELECT name, {grams("text")} AS ws FROM (VALUES {listed}) AS v(name, text))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
passages AS (
    SELECT DISTINCT rid, p FROM (
        SELECT rid, text AS p FROM d
        UNION ALL SELECT rid, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM d
        UNION ALL SELECT rid, unnest(string_split(text, chr(10))) FROM d
    )
),
cut AS (SELECT rid, {pairs} AS pb FROM (SELECT rid, {grams("p")} AS ws FROM passages)),
compared AS (
    SELECT rid, name, 2.0 * len(list_intersect(pb, tb)) / (len(pb) + len(tb)) AS dice
    FROM cut JOIN t ON len(pb) BETWEEN len(tb) * 0.6 AND len(tb) * 1.6
),
best AS (SELECT rid, name, max(dice) AS dice FROM compared WHERE dice >= {licenses.THRESHOLD} GROUP BY rid, name),
told AS (
    SELECT rid, first(name ORDER BY dice DESC, name) AS licence, max(dice) AS dice, array_to_string(list_sort(list(name)), ',') AS licences
    FROM best GROUP BY rid
)
SELECT doc_id, licence, dice, coalesce(licences, '') AS licences FROM d LEFT JOIN told USING (rid)"""


def _mixing_sql() -> str:
    def time_of(knots) -> str:
        cases = []
        for before, after, begin, length, first in mixing.pieces(knots):
            inner = f"least(greatest((share - {before!r}) / ({after!r} - {before!r}), 0.0::DOUBLE), 1.0::DOUBLE)"
            x = f"CASE WHEN {inner} <= 0 THEN 0.0 ELSE {inner} / (sqrt({first * first!r}::DOUBLE + {inner} * {1 - 2 * first!r}::DOUBLE) + {first!r}::DOUBLE) END"
            cases.append(f"WHEN share <= {after!r} THEN {begin!r} + ({x}) * {length!r}")
        return f"CASE {' '.join(cases)} ELSE 1.0 END"

    times = " ".join(f"WHEN turn = {i} THEN {time_of(knots)}" for i, knots in enumerate(mixing.SCHEDULES))
    weights = " ".join(f"WHEN {i} THEN {weight}" for i, weight in enumerate(mixing.WEIGHTS))
    taken = " + ".join(
        f"least(greatest(floor(target)::BIGINT - ({i} * source_size + before), 0), size)" for i in range(mixing.MAX_REPEATS)
    )
    return f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
        substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')), 1, 13) AS place
    FROM documents
),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS turn
    FROM d GROUP BY source
),
b AS (SELECT *, CASE turn {weights} END AS weight, source_size * {mixing.MAX_REPEATS} AS bound, sum(source_size) OVER () * {mixing.SHARE_PERCENT / 100} AS budget FROM s),
l AS (
    SELECT *, coalesce(sum(bound) OVER o, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
    FROM b WINDOW o AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f AS (SELECT *, weight_left * bound <= (budget - full_before) * weight AS is_full FROM l),
r AS (
    SELECT *, budget - sum(CASE WHEN is_full THEN bound ELSE 0 END) OVER () AS rest,
        sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS rest_weight
    FROM f
),
t AS (SELECT source, source_size, turn, CASE WHEN is_full THEN bound::DOUBLE ELSE rest::DOUBLE * weight / rest_weight END AS target FROM r),
p AS (
    SELECT doc_id, source, size, coalesce(sum(size) OVER (
        PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM d
),
a AS (SELECT p.*, source_size, turn, target, before::DOUBLE / target AS share FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, ({taken})::BIGINT AS taken FROM a)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
    CASE WHEN taken > 0 THEN round(CASE {times} END, 6) END AS position
FROM e"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": _quality_sql(),
        "op5_benchmark_decontamination": _decontamination_sql(),
        "op6_license_scan": _license_sql(),
        "op9_mixing": _mixing_sql(),
    }
