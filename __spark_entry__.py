
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.hashing import bin_of, word_hash
from wordloom.operators import postings as words
from wordloom.operators import search as find
from wordloom.operators.requests import request_sequences, request_words
from wordloom.plans import indexing
from wordloom.plans.layout import Layout
from wordloom.schemas import POSTING
from wordloom.session import configure, shared_folder
from wordloom.sources import corpus as corpora
from wordloom.sources.state import latest_state
from wordloom.sources.stopwords import read_stopwords
from wordloom.sources.texts import text_rows
from wordloom.streaming.indexer import index_stream, read_text_stream

try:
    import corpus_pipeline
    from wordloom.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "wordloom.llm"):
        raise
    corpus_pipeline = llm = None

BINS = 19
TEXT_BUCKETS = 8
BATCH_ROWS = 150
LANGUAGES = ("en", "fr", "de", "es")
STOPWORDS = {"en": ["the", "and", "of"], "fr": ["de", "la", "le"], "de": ["die", "der"], "es": ["el", "la", "de"]}
STOPWORD_LIST = sorted({word for listed in STOPWORDS.values() for word in listed})
# Asked besides the passages of ``benchmark``; the ids stay clear of the ids of passages.
PHRASES = [
    "attion to",
    "to is",
    "Attion to, thanedble",
    "ietzte stteen erachtz",
    "orre orre",
    "attion to attion",
    "zzznope is",
    "the",
    "is",
    "IS",
    "für",
]
FIRST_PHRASE_ID = 1_000_000_000
# Some results of the phrases come from here.
MISSING_SOURCE = "src10"


# --- inputs -----------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.read_corpus(spark, f"{sf_dir}/documents.parquet", key="doc_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"lang": "lang", "source": "source", "n_chars": "n_chars", "text": "text"}
    return corpora.prepare(_documents(spark, sf_dir), "doc_id", LANGUAGES, columns, keep_ids=True)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("request")
    )
    listed = F.posexplode(F.array(*[F.lit(phrase) for phrase in PHRASES])).alias("i", "request")
    phrases = spark.range(1).select(listed).select(
        (F.col("i") + F.lit(FIRST_PHRASE_ID)).cast("bigint").alias("query_id"), "request"
    )
    return passages.unionByName(phrases)


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_sequences(_requests(spark, sf_dir), STOPWORD_LIST)


_libraries: dict[tuple[str, str], Layout] = {}


def _library(spark: SparkSession, sf_dir: str) -> Layout:
    """The indexed documents of a scale, built once per session in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _libraries:
        layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
        indexing.index_corpus(spark, layout, {"all": _texts(spark, sf_dir)}, STOPWORD_LIST)
        _libraries[key] = layout
    return _libraries[key]


def _open(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    layout = _library(spark, sf_dir)
    return (
        indexing.open_index(spark, layout),
        indexing.open_vocabulary(spark, layout),
        indexing.open_texts(spark, layout),
    )


def _flat(postings: DataFrame, *more: str | Column) -> DataFrame:
    """Postings with comparable types: positions as text."""
    return postings.select(
        F.col("bin").cast("bigint").alias("bin"),
        "hash",
        "text_id",
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        F.col("total_words").cast("bigint").alias("total_words"),
        *more,
    )


def _scores(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.col("rank").cast("bigint"))


# --- corpus -----------------------------------------------------------------------------------


def corpus_batch_slice(spark, sf_dir):
    sliced = corpora.batch_slice(_documents(spark, sf_dir), "doc_id", BATCH_ROWS, 2, 5)
    return sliced.select("batch_no", "doc_id", "lang", "text")


def corpus_prepare(spark, sf_dir):
    columns = {"doc_id": "doc_id", "source": "title", "lang": "lang", "text": "text"}
    return corpora.prepare(_documents(spark, sf_dir), "doc_id", ("en", "de"), columns, start=101)


def corpus_counts(spark, sf_dir):
    batches = corpora.batch_slice(_documents(spark, sf_dir), "doc_id", BATCH_ROWS, 1, 2**31)
    return corpora.batch_counts(batches, ("en", "de"), previous=100)


def corpus_state(spark, sf_dir):
    layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
    texts = _texts(spark, sf_dir)
    for batches in ({"001": "lang = 'en'", "002": "lang = 'de'"}, {"002": "lang = 'de'", "2024-01-01": "lang NOT IN ('en', 'de')"}):
        indexing.index_corpus(spark, layout, {batch_id: texts.where(of) for batch_id, of in batches.items()}, STOPWORD_LIST)
    return latest_state(spark.read.parquet(layout.state)).select("texts_total")


def stopwords(spark, sf_dir):
    path = shared_folder(spark)
    spark.range(1).select(F.lit(json.dumps(STOPWORDS)).alias("value")).coalesce(1).write.text(path)
    listed = F.broadcast(read_stopwords(spark, path, LANGUAGES))
    tokens = words.tokenize(_texts(spark, sf_dir))
    used = tokens.join(listed, "word").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("occurrences"))
    return listed.join(used, ["lang", "word"], "left").fillna(0, ["occurrences"])


def text_store(spark, sf_dir):
    _, _, texts = _open(spark, sf_dir)
    return text_rows(texts, TEXT_BUCKETS).withColumn("text_bucket", F.col("text_bucket").cast("bigint"))


def text_read(spark, sf_dir):
    """All or nothing, with the texts of one source missing."""
    index, vocabulary, texts = _open(spark, sf_dir)
    hits = find.multi_word_search(index, _sequences(spark, sf_dir), BINS, 5, vocabulary)
    return _scores(find.read_texts(hits, texts.where(f"source <> '{MISSING_SOURCE}'"), TEXT_BUCKETS, require_all=True))


def texts_missing(spark, sf_dir):
    index, vocabulary, texts = _open(spark, sf_dir)
    hits = find.multi_word_search(index, _sequences(spark, sf_dir), BINS, 5, vocabulary)
    return find.missing_texts(hits, texts.where(f"source <> '{MISSING_SOURCE}'"), TEXT_BUCKETS)


# --- words and postings -----------------------------------------------------------------------


def _positions_as_bigint(tokens: DataFrame) -> DataFrame:
    return tokens.select("text_id", F.col("position").cast("bigint").alias("position"), "word")


def tokenize(spark, sf_dir):
    return _positions_as_bigint(words.tokenize(_texts(spark, sf_dir)))


def tokenize_stopwords(spark, sf_dir):
    return _positions_as_bigint(words.tokenize(_texts(spark, sf_dir), STOPWORD_LIST))


def word_hashes(spark, sf_dir):
    used = words.tokenize(_texts(spark, sf_dir)).select("word").distinct()
    return used.select("word", word_hash(F.col("word")).alias("hash"))


def bin_assignment(spark, sf_dir):
    return word_hashes(spark, sf_dir).select("hash", bin_of(F.col("hash"), 499).cast("bigint").alias("bin"))


def postings(spark, sf_dir):
    return _flat(words.postings(_texts(spark, sf_dir), BINS, STOPWORD_LIST))


def vocabulary(spark, sf_dir):
    counted = words.vocabulary(words.postings(_texts(spark, sf_dir), BINS, STOPWORD_LIST))
    return counted.withColumn("bin", F.col("bin").cast("bigint"))


# --- index ------------------------------------------------------------------------------------


def _appended(spark: SparkSession, sf_dir: str, formatted: bool) -> Layout:
    """Two batches, by language; formatted after each if asked."""
    layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
    since = indexing.now()
    texts = _texts(spark, sf_dir)
    for batch_id, batch in (("en", texts.where("lang = 'en'")), ("rest", texts.where("lang <> 'en'"))):
        new_postings = words.postings(batch, BINS, STOPWORD_LIST)
        indexing.append_postings(layout, new_postings, batch_id)
        if formatted:
            indexing.format_index(spark, layout, since)
            since = indexing.now()
    return layout


def index_append(spark, sf_dir):
    return _flat(indexing.open_staging(spark, _appended(spark, sf_dir, False)), "batch_id")


def touched_hashes(spark, sf_dir):
    touched = indexing.open_touched(spark, _appended(spark, sf_dir, False))
    return touched.select("batch_id", F.col("bin").cast("bigint").alias("bin"), "hash")


def index_format(spark, sf_dir):
    return _flat(indexing.open_index(spark, _appended(spark, sf_dir, True)))


def index_replace(spark, sf_dir):
    """A batch that was formatted and is then replaced by other texts: only those are left."""
    layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
    texts = _texts(spark, sf_dir)
    for version in ("lang = 'en'", "lang <> 'en'"):
        indexing.index_corpus(spark, layout, {"001": texts.where(version)}, STOPWORD_LIST)
    return _flat(indexing.open_index(spark, layout))


def stream_index(spark, sf_dir):
    layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
    arriving = f"{layout.root}/arriving"
    texts = _texts(spark, sf_dir)
    texts.write.parquet(arriving)
    # A third of the files at a time, however many there are.
    files = len(spark.read.parquet(arriving).inputFiles())
    stream = read_text_stream(spark, arriving, texts.schema, files_per_batch=-(-files // 3))
    index_stream(stream, layout, f"{layout.root}/checkpoint", STOPWORD_LIST)
    return _flat(indexing.open_index(spark, layout))


def _in_runs(spark: SparkSession, sf_dir: str, runs: int) -> Layout:
    """A library built in several runs: one of most texts, then small ones of a few texts each."""
    layout = Layout(shared_folder(spark), BINS, TEXT_BUCKETS)
    texts = _texts(spark, sf_dir)
    indexing.index_corpus(spark, layout, {"base": texts.where(f"text_id % 50 >= {runs}")}, STOPWORD_LIST)
    for run in range(runs):
        indexing.index_corpus(spark, layout, {str(run): texts.where(f"text_id % 50 = {run}")}, STOPWORD_LIST)
    return layout


def index_generations(spark, sf_dir):
    """Two small generations beside the base, read as one index, with the batch of each posting."""
    return _flat(indexing.open_staging(spark, _in_runs(spark, sf_dir, 2)), "batch_id")


def vocabulary_generations(spark, sf_dir):
    """The counts of several generations, added up when they are read."""
    counted = indexing.open_vocabulary(spark, _in_runs(spark, sf_dir, 2))
    return counted.withColumn("bin", F.col("bin").cast("bigint"))


def index_merge(spark, sf_dir):
    """Four small runs, so that their generations have become one."""
    return _flat(indexing.open_index(spark, _in_runs(spark, sf_dir, 4)))


def text_store_compaction(spark, sf_dir):
    """Texts of four small runs in one generation, and one batch that was replaced and waits for a format."""
    layout = _in_runs(spark, sf_dir, 4)
    indexing.append_batch(layout, _texts(spark, sf_dir).where("text_id % 100 = 0"), "0", STOPWORD_LIST)
    stored = indexing.open_texts(spark, layout)
    return stored.withColumn("text_bucket", F.col("text_bucket").cast("bigint"))


def search_generations(spark, sf_dir):
    """The flagship query on an index of several generations."""
    layout = _in_runs(spark, sf_dir, 2)
    found = find.search(
        indexing.open_index(spark, layout),
        indexing.open_texts(spark, layout),
        _requests(spark, sf_dir),
        BINS,
        stopwords=STOPWORD_LIST,
        vocabulary=indexing.open_vocabulary(spark, layout),
        text_buckets=TEXT_BUCKETS,
    )
    return _scores(found)


# --- search -----------------------------------------------------------------------------------


def request_hash(spark, sf_dir):
    asked = request_words(_sequences(spark, sf_dir))
    return asked.select("query_id", "hash", *[F.col(name).cast("bigint").alias(name) for name in ("ord", "alias", "n", "k")])


def posting_lookup(spark, sf_dir):
    index, known, _ = _open(spark, sf_dir)
    found = find.posting_lookup(index, _sequences(spark, sf_dir), BINS, known)
    return found.select(
        "query_id",
        F.col("alias").cast("bigint").alias("alias"),
        "text_id",
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        F.col("total_words").cast("bigint").alias("total_words"),
    )


def all_words_filter(spark, sf_dir):
    index, known, _ = _open(spark, sf_dir)
    found = find.all_words_filter(index, _sequences(spark, sf_dir), BINS, known)
    return found.withColumn("total_words", F.col("total_words").cast("bigint"))


def _search(spark: SparkSession, sf_dir: str, operator, *options) -> DataFrame:
    index, known, _ = _open(spark, sf_dir)
    return _scores(operator(index, _sequences(spark, sf_dir), BINS, *options, vocabulary=known))


def single_word_search(spark, sf_dir):
    return _search(spark, sf_dir, find.single_word_search, 10)


def multi_word_search(spark, sf_dir):
    return _search(spark, sf_dir, find.multi_word_search, 10)


def phrase_search(spark, sf_dir):
    return _search(spark, sf_dir, find.phrase_search, 10)


def ranked_topk(spark, sf_dir):
    return _search(spark, sf_dir, find.search_hits, 50, "run")


def search(spark, sf_dir):
    index, known, texts = _open(spark, sf_dir)
    return _scores(
        find.search(
            index,
            texts,
            _requests(spark, sf_dir),
            BINS,
            stopwords=STOPWORD_LIST,
            vocabulary=known,
            text_buckets=TEXT_BUCKETS,
        )
    )


def search_many_requests(spark, sf_dir):
    """One request per text, its first words: more results than are held on the driver."""
    index, known, texts = _open(spark, sf_dir)
    first_words = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    asked = texts.select(F.col("text_id").alias("query_id"), first_words.alias("request"))
    found = find.search(
        index, texts, asked, BINS, 20, "exact", STOPWORD_LIST, vocabulary=known, text_buckets=TEXT_BUCKETS, require_all=True
    )
    return _scores(found).select("query_id", "rank", "text_id", *find.HIT_COLUMNS, "source", F.md5("text").alias("text_md5"))


def search_blake2b(spark, sf_dir):
    """The flagship query with the other digest."""
    texts = _texts(spark, sf_dir)
    # Read several times by one search, so it is stored.
    path = shared_folder(spark)
    indexing.write_postings(words.postings(texts, BINS, STOPWORD_LIST, digest="blake2b"), path)
    index = spark.read.schema(POSTING).parquet(path)
    return _scores(find.search(index, texts, _requests(spark, sf_dir), BINS, stopwords=STOPWORD_LIST, digest="blake2b"))


def search_summary(spark, sf_dir):
    index, known, _ = _open(spark, sf_dir)
    hits = find.search_hits(index, _sequences(spark, sf_dir), BINS, 10, "run", known)
    return find.search_summary(_requests(spark, sf_dir), hits)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: answer all requests on the indexed documents."""
    return search(configure(spark), "/root/testdata/sf0.001")


def _configured(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(configure(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = {**llm.queries(), "pipeline": corpus_pipeline.run} if llm else {}
    own = {
        "corpus_batch_slice": corpus_batch_slice,
        "corpus_prepare": corpus_prepare,
        "corpus_counts": corpus_counts,
        "corpus_state": corpus_state,
        "stopwords": stopwords,
        "text_store": text_store,
        "text_read": text_read,
        "texts_missing": texts_missing,
        "tokenize": tokenize,
        "tokenize_stopwords": tokenize_stopwords,
        "word_hash": word_hashes,
        "bin_assignment": bin_assignment,
        "postings": postings,
        "vocabulary": vocabulary,
        "index_append": index_append,
        "touched_hashes": touched_hashes,
        "index_format": index_format,
        "index_replace": index_replace,
        "index_generations": index_generations,
        "vocabulary_generations": vocabulary_generations,
        "index_merge": index_merge,
        "text_store_compaction": text_store_compaction,
        "stream_index": stream_index,
        "request_hash": request_hash,
        "posting_lookup": posting_lookup,
        "all_words_filter": all_words_filter,
        "single_word_search": single_word_search,
        "multi_word_search": multi_word_search,
        "phrase_search": phrase_search,
        "ranked_topk": ranked_topk,
        "search": search,
        "search_generations": search_generations,
        "search_many_requests": search_many_requests,
        "search_blake2b": search_blake2b,
        "search_summary": search_summary,
    }
    return more | {name: _configured(query) for name, query in own.items()}


# --- the same in SQL --------------------------------------------------------------------------


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def _sql_words(text: str, drop_stopwords: bool = True) -> str:
    found = f"regexp_extract_all(lower(strip_accents({text})), '[0-9]+|\\p{{L}}+')"
    if not drop_stopwords:
        return found
    return f"list_filter({found}, lambda w: NOT list_contains({_sql_list(STOPWORD_LIST)}, w))"


def _sql_bin(hash_column: str, bins: int) -> str:
    limbs = f"[('0x' || substr({hash_column}, i * 8 + 1, 8))::BIGINT FOR i IN range(8)]"
    return f"(list_reduce(list_prepend(0::BIGINT, {limbs}), lambda a, v: (a * (4294967296 % {bins}) + v) % {bins}) + 1)::BIGINT"


def _sql_tokens(drop_stopwords: bool = True) -> str:
    """texts(text_id, w) and tokens(text_id, position, word, total_words)"""
    return f"""
texts AS (SELECT doc_id AS text_id, {_sql_words("text", drop_stopwords)} AS w FROM documents),
tokens AS (
    SELECT text_id, (generate_subscripts(w, 1) - 1)::BIGINT AS position, unnest(w) AS word, len(w)::BIGINT AS total_words
    FROM texts
)"""


def _sql_postings() -> str:
    return f"""{_sql_tokens()},
grouped AS (
    SELECT text_id, word, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions,
           count(*) AS occurrences, any_value(total_words) AS total_words
    FROM tokens GROUP BY text_id, word
),
hashes AS (SELECT word, sha256(word) AS hash FROM (SELECT DISTINCT word FROM tokens)),
bins AS (SELECT word, hash, {_sql_bin("hash", BINS)} AS bin FROM hashes),
postings AS MATERIALIZED (
    SELECT bin, hash, text_id, positions, total_words, occurrences, word FROM grouped JOIN bins USING (word)
)"""


def _sql_listed_requests() -> str:
    phrases = ", ".join(f"({FIRST_PHRASE_ID + i}::BIGINT, '{phrase}')" for i, phrase in enumerate(PHRASES))
    return f"""
    SELECT item_id AS query_id, text AS request FROM benchmark
    UNION ALL SELECT * FROM (VALUES {phrases}) AS p(query_id, request)"""


def _sql_requests(listed: str | None = None) -> str:
    """requests(query_id, request), sequences(query_id, seq), asked(query_id, ord, word, alias, n, k)"""
    return f"""
requests AS ({listed or _sql_listed_requests()}
),
sequences AS (SELECT query_id, {_sql_words("request")} AS seq FROM requests),
numbered AS (
    SELECT query_id, (generate_subscripts(seq, 1) - 1)::BIGINT AS ord, unnest(seq) AS word, len(seq)::BIGINT AS n FROM sequences
),
firsts AS (SELECT query_id, word, min(ord) AS seen FROM numbered GROUP BY query_id, word),
aliased AS (
    SELECT query_id, word, (row_number() OVER (PARTITION BY query_id ORDER BY seen) - 1)::BIGINT AS alias,
           (count(*) OVER (PARTITION BY query_id))::BIGINT AS k
    FROM firsts
),
asked AS (SELECT query_id, ord, word, alias, n, k FROM numbered JOIN aliased USING (query_id, word))"""


def _sql_matches(listed: str | None = None) -> str:
    """all_words(query_id, text_id, total_words)"""
    return f"""{_sql_postings()},{_sql_requests(listed)},
all_words AS (
    SELECT query_id, text_id, any_value(total_words) AS total_words
    FROM aliased JOIN postings USING (word) GROUP BY query_id, text_id HAVING count(*) = any_value(k)
)"""


def _sql_hits(mode: str, listed: str | None = None) -> str:
    """ranked(query_id, text_id, hits, matching_words, total_words, matching_words_frequency, n, rank)"""
    if mode == "run":
        counted = """
marks AS (
    SELECT query_id, text_id, position, word FROM all_words JOIN aliased USING (query_id) JOIN tokens USING (text_id, word)
),
breaks AS (
    SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY query_id, text_id ORDER BY position) = 1 THEN 0 ELSE 1 END AS brk
    FROM marks
),
cut AS (
    SELECT *, sum(brk) OVER (PARTITION BY query_id, text_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS run FROM breaks
),
runs AS (SELECT query_id, text_id, run, list(word ORDER BY position) AS s FROM cut GROUP BY query_id, text_id, run),
counted AS (
    SELECT query_id, text_id, len(seq)::BIGINT AS n,
           (CASE WHEN len(seq) = 1 THEN sum(len(s))
                 ELSE count(*) FILTER (WHERE len(s) >= len(seq) AND (s[1:len(seq)] = seq OR s[len(s) - len(seq) + 1:] = seq))
            END)::BIGINT AS hits
    FROM runs JOIN sequences USING (query_id) GROUP BY query_id, text_id, seq
)"""
    else:
        counted = """
starts AS (
    SELECT query_id, text_id, position - ord AS start, any_value(n) AS n
    FROM all_words JOIN asked USING (query_id) JOIN tokens USING (text_id, word)
    GROUP BY query_id, text_id, position - ord HAVING count(*) = any_value(n)
),
counted AS (SELECT query_id, text_id, any_value(n) AS n, count(*) AS hits FROM starts GROUP BY query_id, text_id)"""
    return f"""{_sql_matches(listed)},{counted},
scored AS (
    SELECT query_id, text_id, hits, hits * n AS matching_words, total_words, n,
           round(hits * n / total_words, 5) AS matching_words_frequency
    FROM counted JOIN all_words USING (query_id, text_id) WHERE hits > 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matching_words_frequency DESC, text_id) AS rank FROM scored
)"""


def oracle_sql() -> dict[str, str]:
    scores = "query_id, rank, text_id, hits, matching_words, total_words, matching_words_frequency"
    postings_columns = "bin, hash, text_id, positions, total_words"
    in_order = "row_number() OVER (ORDER BY doc_id)"
    listed = ", ".join(f"('{lang}', '{word}')" for lang, entries in STOPWORDS.items() for word in entries)
    batch = "CASE WHEN lang = 'en' THEN 'en' ELSE 'rest' END AS batch_id"
    more = llm.oracle_sql() if llm else {}
    if llm and corpus_pipeline.ORACLE_SQL:
        more["pipeline"] = corpus_pipeline.ORACLE_SQL
    return more | {
        "corpus_batch_slice": f"""
            WITH n AS (SELECT *, (({in_order}) - 1) // {BATCH_ROWS} + 1 AS batch_no FROM documents)
            SELECT batch_no, doc_id, lang, text FROM n WHERE batch_no BETWEEN 2 AND 5""",
        "corpus_prepare": f"""
            SELECT {in_order} + 100 AS text_id, doc_id, source AS title, lang, text FROM documents WHERE lang IN ('en', 'de')""",
        "corpus_counts": f"""
            WITH n AS (SELECT *, (({in_order}) - 1) // {BATCH_ROWS} + 1 AS batch_no FROM documents),
            c AS (SELECT batch_no, count(*) FILTER (WHERE lang IN ('en', 'de')) AS texts FROM n GROUP BY batch_no),
            r AS (SELECT batch_no, texts, (sum(texts) OVER (ORDER BY batch_no))::BIGINT AS run_total FROM c)
            SELECT batch_no, texts, run_total, run_total + 100 AS combined_total FROM r""",
        "corpus_state": "SELECT count(*) AS texts_total FROM documents",
        "stopwords": f"""
            WITH {_sql_tokens(False)},
            listed AS (SELECT * FROM (VALUES {listed}) AS s(lang, word)),
            used AS (SELECT word, count(*) AS occurrences FROM tokens GROUP BY word)
            SELECT lang, word, coalesce(occurrences, 0) AS occurrences FROM listed LEFT JOIN used USING (word)""",
        "text_store": f"""
            SELECT doc_id AS text_id, lang, source, n_chars, text, doc_id % {TEXT_BUCKETS} AS text_bucket FROM documents""",
        "text_read": f"""
            WITH {_sql_hits("run")}
            SELECT {scores}, lang, source, n_chars, text
            FROM ranked JOIN documents ON doc_id = text_id WHERE n > 1 AND rank <= 5 AND query_id NOT IN (
                SELECT query_id FROM ranked JOIN documents ON doc_id = text_id
                WHERE n > 1 AND rank <= 5 AND source = '{MISSING_SOURCE}'
            )""",
        "texts_missing": f"""
            WITH {_sql_hits("run")}
            SELECT query_id, text_id FROM ranked JOIN documents ON doc_id = text_id
            WHERE n > 1 AND rank <= 5 AND source = '{MISSING_SOURCE}'""",
        "tokenize": f"WITH {_sql_tokens(False)} SELECT text_id, position, word FROM tokens",
        "tokenize_stopwords": f"WITH {_sql_tokens()} SELECT text_id, position, word FROM tokens",
        "word_hash": f"WITH {_sql_tokens(False)} SELECT DISTINCT word, sha256(word) AS hash FROM tokens",
        "bin_assignment": f"""
            WITH {_sql_tokens(False)}, h AS (SELECT DISTINCT sha256(word) AS hash FROM tokens)
            SELECT hash, {_sql_bin("hash", 499)} AS bin FROM h""",
        "postings": f"WITH {_sql_postings()} SELECT {postings_columns} FROM postings",
        "vocabulary": f"""
            WITH {_sql_postings()}
            SELECT bin, hash, count(*) AS texts, sum(occurrences)::BIGINT AS occurrences FROM postings GROUP BY bin, hash""",
        "index_append": f"""
            WITH {_sql_postings()}
            SELECT {postings_columns}, {batch} FROM postings JOIN documents ON doc_id = text_id""",
        "touched_hashes": f"""
            WITH {_sql_postings()}
            SELECT DISTINCT {batch}, bin, hash FROM postings JOIN documents ON doc_id = text_id""",
        "index_format": f"WITH {_sql_postings()} SELECT {postings_columns} FROM postings",
        "index_replace": f"""
            WITH {_sql_postings()}
            SELECT {postings_columns} FROM postings JOIN documents ON doc_id = text_id WHERE lang <> 'en'""",
        "index_generations": f"""
            WITH {_sql_postings()}
            SELECT {postings_columns}, CASE WHEN text_id % 50 < 2 THEN (text_id % 50)::VARCHAR ELSE 'base' END AS batch_id FROM postings""",
        "vocabulary_generations": f"""
            WITH {_sql_postings()}
            SELECT bin, hash, count(*) AS texts, sum(occurrences)::BIGINT AS occurrences FROM postings GROUP BY bin, hash""",
        "index_merge": f"WITH {_sql_postings()} SELECT {postings_columns} FROM postings",
        "text_store_compaction": f"""
            SELECT doc_id AS text_id, lang, source, n_chars, text, doc_id % {TEXT_BUCKETS} AS text_bucket,
                   CASE WHEN doc_id % 50 < 4 THEN (doc_id % 50)::VARCHAR ELSE 'base' END AS batch_id
            FROM documents WHERE doc_id % 100 <> 50""",
        "stream_index": f"WITH {_sql_postings()} SELECT {postings_columns} FROM postings",
        "request_hash": f"WITH {_sql_requests()} SELECT query_id, ord, sha256(word) AS hash, alias, n, k FROM asked",
        "posting_lookup": f"""
            WITH {_sql_tokens()},{_sql_requests()},
            found AS MATERIALIZED (
                SELECT word, text_id, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions, any_value(total_words) AS total_words
                FROM tokens WHERE word IN (SELECT word FROM aliased) GROUP BY word, text_id
            ),
            gate AS (
                SELECT query_id FROM aliased WHERE word IN (SELECT word FROM found)
                GROUP BY query_id HAVING count(*) = any_value(k)
            )
            SELECT query_id, alias, text_id, positions, total_words
            FROM gate JOIN aliased USING (query_id) JOIN found USING (word)""",
        "all_words_filter": f"WITH {_sql_matches()} SELECT query_id, text_id, total_words FROM all_words",
        "single_word_search": f"WITH {_sql_hits('run')} SELECT {scores} FROM ranked WHERE n = 1 AND rank <= 10",
        "multi_word_search": f"WITH {_sql_hits('run')} SELECT {scores} FROM ranked WHERE n > 1 AND rank <= 10",
        "phrase_search": f"WITH {_sql_hits('exact')} SELECT {scores} FROM ranked WHERE rank <= 10",
        "ranked_topk": f"WITH {_sql_hits('run')} SELECT {scores} FROM ranked WHERE rank <= 50",
        "search": f"""
            WITH {_sql_hits("run")}
            SELECT {scores}, lang, source, n_chars, text FROM ranked JOIN documents ON doc_id = text_id WHERE rank <= 10""",
        "search_generations": f"""
            WITH {_sql_hits("run")}
            SELECT {scores}, lang, source, n_chars, text FROM ranked JOIN documents ON doc_id = text_id WHERE rank <= 10""",
        "search_many_requests": f"""
            WITH {_sql_hits("exact", "SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS request FROM documents")}
            SELECT {scores}, source, md5(text) AS text_md5 FROM ranked JOIN documents ON doc_id = text_id WHERE rank <= 20""",
        "search_blake2b": f"""
            WITH {_sql_hits("run")}
            SELECT {scores}, lang, source, n_chars, text FROM ranked JOIN documents ON doc_id = text_id WHERE rank <= 10""",
        "search_summary": f"""
            WITH {_sql_hits("run")},
            c AS (SELECT query_id, count(*) AS results FROM ranked WHERE rank <= 10 GROUP BY query_id)
            SELECT query_id, request, coalesce(results, 0) AS results, coalesce(results, 0) > 0 AS matched,
                   CASE WHEN coalesce(results, 0) = 0 THEN 'No matching texts were found.' END AS message
            FROM requests LEFT JOIN c USING (query_id)""",
    }
