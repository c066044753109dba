"""Search: from requests and postings to ranked texts.

Requests of one word are ranked where their postings lie. For the others the words of each text meet first, as
numbers and without positions; a request is tested only in texts that hold its rarest word. Positions are then
read for the texts that have all words of some request. Where requests are too many for the driver program, their first
two words are looked up among the neighbouring words of each text instead. Equal requests are answered once.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.hashing import bin_of
from wordloom.functions.matching import aliases, exact_hits, frequency, places, run_hits, settle
from wordloom.operators.marks import thinned
from wordloom.operators.neighbours import adjacent_words
from wordloom.operators.postings import Stopwords
from wordloom.operators.requests import request_sequences
from wordloom.session import shared_folder

MODES = ("run", "exact")

# Up to this many hashes are placed into the scan as values; beyond, they are joined.
MAX_LITERALS = 500
# Rows, and words in them, of a request side that is computed once and kept as a local table (a word is 64 bytes).
MAX_PINNED = 10_000
MAX_PINNED_WORDS = 500_000
# Rows, and words in them, of a request side that may be broadcast; beyond, the planner chooses the join.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_WORDS = 1_000_000
# Ranked results that are held as a local table, so that their ids become values in the scan of the texts: ids and
# scores, some 100 bytes a row. More results are written and joined.
MAX_RESULTS = 10_000
# Ranked results that are sent to the texts of some buckets at a time.
MAX_BROADCAST_RESULTS = 500_000
# Pairs of a text and a request with one driver word that meet in one block, where requests are too many to broadcast.
BLOCK_PAIRS = 1 << 22
# Text ids that may be broadcast to thin out the postings before they are shuffled.
MAX_CANDIDATES = 2_000_000

HIT_COLUMNS = ["hits", "matching_words", "total_words", "matching_words_frequency"]


def _at_most(frame: DataFrame, rows: int, words: int | None = None) -> bool:
    """Whether a frame has no more rows, and no more hashes in them, than a bound; stops reading beyond the rows."""
    size = F.lit(1) if words is None else F.size("hashes")
    count, total = frame.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return count <= rows and (words is None or total <= words)


def _small(frame: DataFrame, is_small: bool) -> DataFrame:
    """Broadcast a side whose size was checked; leave any other join to the planner."""
    return F.broadcast(frame) if is_small else frame


def _pin(frame: DataFrame, most: int) -> tuple[DataFrame, list[dict] | None]:
    """A frame of at most ``most`` short rows as a local table, with its rows; a larger one as it is."""
    table = frame.limit(most + 1).toArrow()
    if table.num_rows > most:
        return frame, None
    return frame.sparkSession.createDataFrame(table, frame.schema), table.to_pylist()


def _written(frame: DataFrame) -> DataFrame:
    """A frame that is read several times, as a stored table."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _word(hash: Column) -> Column:
    """A requested word as a number: 64 bits of its hash, which is long enough to tell the words of requests apart."""
    return F.xxhash64(hash)


class RequestSet:
    """The requests to answer: ``members`` (query_id, seq_id, hashes) and ``distinct`` (seq_id, hashes).

    Equal requests share the seq_id of the first of them. Requests without words match nothing and
    are left out. Calling it filters a table keyed by (bin, hash) to the requested words: few words
    become values in the scan (partition and row-group pruning); more are joined, with the list of
    bins still pruning partitions. Words that are too many to be sent become a bitmap, which lets some
    others through: callers join with the words they ask for. The table is never shuffled.
    """

    def __init__(self, sequences: DataFrame, bins: int):
        some = sequences.where(F.size("hashes") > 0)
        rows = None
        if _at_most(some, MAX_PINNED, MAX_PINNED_WORDS):
            few, (members, rows) = True, self._numbered(some)
        else:
            # Words are taken once.
            some = _written(some)
            first = some.groupBy("hashes").agg(F.min("query_id").alias("seq_id"))
            members = _written(some.join(first, "hashes").select("query_id", "seq_id", "hashes"))
            few = _at_most(some, MAX_BROADCAST_ROWS, MAX_BROADCAST_WORDS)
        self._set(sequences.sparkSession, members, rows, few, bins)

    @staticmethod
    def _numbered(some: DataFrame) -> tuple[DataFrame, list[dict]]:
        """The members of few requests as a local table, numbered without a job of their own."""
        asked = some.select("query_id", "hashes").toArrow()
        first: dict[tuple[str, ...], int] = {}
        rows = sorted(asked.to_pylist(), key=lambda row: row["query_id"])
        for row in rows:
            row["seq_id"] = first.setdefault(tuple(row["hashes"]), row["query_id"])
        columns = {name: pa.array([row[name] for row in rows], asked.schema.field("query_id").type) for name in ("query_id", "seq_id")}
        columns["hashes"] = pa.array([row["hashes"] for row in rows], asked.schema.field("hashes").type)
        return some.sparkSession.createDataFrame(pa.table(columns)), rows

    def _set(self, spark, members: DataFrame, rows: list[dict] | None, few: bool, number_of_bins: int) -> None:
        self.members, self.rows, self.few, self.number_of_bins = members, rows, few, number_of_bins
        self.pinned = rows is not None
        self.distinct = members.where("query_id = seq_id").select("seq_id", "hashes")
        if self.pinned:
            self.hashes = sorted({value for row in rows for value in row["hashes"]})
            placed = [int(value, 16) % number_of_bins + 1 for value in self.hashes]
            self.bins = sorted(set(placed))
            self.small = len(self.hashes) <= MAX_BROADCAST_ROWS
            words = pa.table({"bin": pa.array(placed, pa.int32()), "hash": pa.array(self.hashes, pa.string())})
            self.wanted = spark.createDataFrame(words)
        else:
            self.hashes = None
            hashes = self.distinct.select(F.explode_outer(F.array_distinct("hashes")).alias("hash")).distinct()
            self.wanted = hashes.select(bin_of(F.col("hash"), number_of_bins).alias("bin"), "hash")
            # One number per bin at most.
            self.bins = sorted(row.bin for row in self.wanted.select("bin").distinct().collect())
            self.small = _at_most(self.wanted, MAX_BROADCAST_ROWS)
        self.number_of_words: int | None = None
        self.literal = self.pinned and len(self.hashes) <= MAX_LITERALS

    def part(self, of_one_word: bool) -> RequestSet | None:
        """The requests of one word, or those of several; None where it is known that there are none."""
        size = F.size("hashes")
        members = self.members.where(size == 1 if of_one_word else size > 1)
        rows = None
        if self.pinned:
            rows = [row for row in self.rows if (len(row["hashes"]) == 1) == of_one_word]
            if not rows:
                return None
        chosen = RequestSet.__new__(RequestSet)
        chosen._set(self.members.sparkSession, members, rows, self.few, self.number_of_bins)
        return chosen

    def of_bins(self, table: DataFrame) -> DataFrame:
        """The rows of a table in the bins of the requested words."""
        return table.where(F.col("bin").isin(self.bins))

    def __call__(self, table: DataFrame) -> DataFrame:
        pruned = self.of_bins(table)
        if self.literal:
            return pruned.where(F.col("hash").isin(self.hashes))
        if self.small:
            return pruned.join(F.broadcast(self.wanted), ["bin", "hash"], "left_semi")
        if self.number_of_words is None:
            self.number_of_words = self.wanted.count()
        return thinned(pruned, _word(F.col("hash")), self.wanted, _word(F.col("hash")), self.number_of_words)

    def counts(self, index: DataFrame, vocabulary: DataFrame | None) -> tuple[DataFrame, list[dict] | None]:
        """(hash, texts) of the requested words that the index has; the rows too if they are few."""
        if vocabulary is None:
            counted = self(index).groupBy("hash").agg(F.count(F.lit(1)).alias("texts"))
        else:
            counted = self(vocabulary).select("hash", "texts")
        return _pin(counted, MAX_PINNED) if self.pinned else (counted, None)

    def drivers(self, counts: DataFrame, count_rows: list[dict] | None) -> tuple[DataFrame, list[dict] | None]:
        """(driver, driver_texts, seq_id, hashes): each distinct request under its rarest word.

        A request with a word that the index lacks has no row: it matches nothing. With few requests and words the
        driver program looks them up itself.
        """
        if count_rows is not None:
            known = {row["hash"]: row["texts"] for row in count_rows}
            found = []
            for row in self.rows:
                if row["query_id"] == row["seq_id"] and all(value in known for value in row["hashes"]):
                    texts, driver = min((known[value], value) for value in set(row["hashes"]))
                    found.append({"driver": driver, "driver_texts": texts, "seq_id": row["seq_id"], "hashes": row["hashes"]})
            schema = f"driver string, driver_texts bigint, seq_id {self.members.schema['seq_id'].dataType.simpleString()}, hashes array<string>"
            return self.members.sparkSession.createDataFrame([tuple(row.values()) for row in found], schema), found
        words = self.distinct.select("seq_id", F.explode(F.array_distinct("hashes")).alias("hash"))
        rarest = (
            words.join(_small(counts, self.small), "hash")
            .groupBy("seq_id")
            .agg(F.min(F.struct("texts", "hash")).alias("_rarest"), F.count(F.lit(1)).alias("_known"))
        )
        drivers = (
            self.distinct.join(_small(rarest, self.few), "seq_id")
            .where(F.col("_known") == F.size(F.array_distinct("hashes")))
            .select(
                F.col("_rarest.hash").alias("driver"), F.col("_rarest.texts").alias("driver_texts"), "seq_id", "hashes"
            )
        )
        return drivers, None

    def fan_out(self, matched: DataFrame) -> DataFrame:
        """From distinct requests back to all requests: seq_id becomes query_id."""
        members = self.members.select("query_id", "seq_id")
        return matched.join(_small(members, self.few), "seq_id").drop("seq_id")


def _thinned(found: DataFrame, drivers: list[dict], counts: list[dict]) -> DataFrame:
    """Keep the postings of texts that hold a driver word, if that is a small and much smaller set."""
    rare = {row["driver"]: row["driver_texts"] for row in drivers}
    candidates, everything = sum(rare.values()), sum(row["texts"] for row in counts)
    if candidates > MAX_CANDIDATES or candidates * 4 > everything:
        return found
    ids = found.where(F.col("hash").isin(sorted(rare))).select("text_id").distinct()
    return found.join(F.broadcast(ids), "text_id", "left_semi")


def _with_driver_mark(
    found: DataFrame, chosen: RequestSet, drivers: DataFrame, driver_rows: list[dict] | None
) -> DataFrame:
    """Mark postings of driver words (``_driver``), so that only these open a test of the text."""
    if driver_rows is not None and len(driver_rows) <= MAX_LITERALS:
        return found.withColumn("_driver", F.col("hash").isin(sorted({row["driver"] for row in driver_rows})))
    if chosen.few:
        marks = drivers.select(F.col("driver").alias("hash")).distinct().withColumn("_driver", F.lit(True))
        return found.join(F.broadcast(marks), "hash", "left")
    return found.withColumn("_driver", F.lit(True))


def match_words(index: DataFrame, chosen: RequestSet, vocabulary: DataFrame | None = None) -> DataFrame:
    """(seq_id, hashes, text_id, total_words): texts that hold all words of a request.

    One shuffle, by text, of the requested words as numbers; positions are not read. Rare words thin out the others
    before it. Counts come from ``vocabulary`` if given, else from the index. The index is read several times, so it
    should be a stored table.
    """
    found = chosen(index).select("hash", "text_id", "total_words")
    counts, count_rows = chosen.counts(index, vocabulary)
    drivers, driver_rows = chosen.drivers(counts, count_rows)
    if count_rows is not None and driver_rows is not None:
        found = _thinned(found, driver_rows, count_rows)
    marked = _with_driver_mark(found, chosen, drivers, driver_rows)
    by_text = (
        marked.select("text_id", "total_words", "_driver", _word(F.col("hash")).alias("word"))
        .groupBy("text_id")
        .agg(
            F.max("total_words").alias("total_words"),
            F.collect_set("word").alias("words"),
            F.collect_set(F.when(F.col("_driver"), F.col("word"))).alias("_drivers"),
        )
    )
    # The outer form keeps the optimizer from building the set of drivers twice.
    held = by_text.select("text_id", "total_words", "words", F.explode_outer("_drivers").alias("driver"))
    requests = drivers.select(
        _word(F.col("driver")).alias("driver"),
        "seq_id",
        "hashes",
        F.transform(F.array_distinct("hashes"), _word).alias("asked"),
    )
    if chosen.few:
        pairs = held.join(F.broadcast(requests), "driver")
    else:
        pairs = _pairs_in_blocks(held, requests, drivers)
    has_all = F.size(F.array_except("asked", "words")) == 0
    return pairs.where(has_all).select("seq_id", "hashes", "text_id", "total_words")


def _pairs_in_blocks(held: DataFrame, requests: DataFrame, drivers: DataFrame) -> DataFrame:
    """Texts and requests that share a driver word, a task never more than ``BLOCK_PAIRS`` or so of one word.

    Of a hot word, with many requests or many texts or both, the requests are cut into blocks and so are the texts;
    every two blocks meet under a key of their own. Texts are copied once per block of requests and the other way round.
    """
    side = int(BLOCK_PAIRS**0.5)
    load = drivers.groupBy("driver").agg(F.count(F.lit(1)).alias("requests"), F.max("driver_texts").alias("texts"))

    def blocks(mine: str, other: str) -> Column:
        # A short other side leaves room for longer blocks of this one.
        return F.ceil(F.col(mine) * F.least(F.col(other), F.lit(side)) / F.lit(BLOCK_PAIRS)).cast("int")

    # Each hot word stands for ``BLOCK_PAIRS`` pairs and is one row here.
    hot = load.where(F.col("requests") * F.col("texts") > BLOCK_PAIRS).select(
        _word(F.col("driver")).alias("driver"),
        blocks("requests", "texts").alias("_request_blocks"),
        blocks("texts", "requests").alias("_text_blocks"),
    )
    hot = _small(hot, _at_most(hot, MAX_BROADCAST_ROWS))

    def one(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1))

    def cut(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its own block, and once for every block of the other side."""
        marked = rows.join(hot, "driver", "left")
        block = F.pmod(F.xxhash64(key), one(own)).cast("int").alias(own + "_at")
        every = F.explode(F.sequence(F.lit(0), one(other) - 1)).alias(other + "_at")
        return marked.select(*rows.columns, block, every)

    texts = cut(held, "text_id", "_text_blocks", "_request_blocks")
    asked = cut(requests, "seq_id", "_request_blocks", "_text_blocks")
    return texts.join(asked, ["driver", "_text_blocks_at", "_request_blocks_at"])


def match_texts(index: DataFrame, chosen: RequestSet, vocabulary: DataFrame | None = None) -> DataFrame:
    """``match_words`` with ``places``, the positions per word of the request; only texts that match are read for them."""
    matched = match_words(index, chosen, vocabulary)
    postings = chosen(index).select(_word(F.col("hash")).alias("word"), "text_id", "positions")
    ids = matched.select("text_id").distinct()
    held = (
        postings.join(ids, "text_id", "left_semi")
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("word", "positions")).alias("held"))
    )
    asked = F.transform("hashes", _word)
    return matched.join(held, "text_id").select(
        "seq_id", "hashes", "text_id", "total_words", places(F.col("held"), asked).alias("places")
    )


def _phrase_starts(index: DataFrame, chosen: RequestSet, best: int | None = None) -> DataFrame:
    """(seq_id, n, text_id, total_words, position, hits, ...): where the first two words of a request stand side by side.

    Every hit, in either mode, begins like that. Where requests are many this is what bounds the pairs: the texts that
    merely hold all words of a request grow with requests times texts, these with the words of the texts.
    ``hits`` counts the places of a request in a text. With ``best`` a text and request is one row, its first place, and of
    requests of two words only so many texts are left, the best by exact hits.
    """
    words = chosen(index).select("text_id", "total_words", "positions", _word(F.col("hash")).alias("word"))
    requests = chosen.distinct.select(
        _word(F.get("hashes", F.lit(0))).alias("word"), _word(F.get("hashes", F.lit(1))).alias("next"), "seq_id", F.size("hashes").alias("n")
    )
    # Pairs that nobody asks for are most; they go where the texts meet, and the few left are joined.
    pairs = adjacent_words(words, chosen.of_bins(index).count(), requests)
    if best is not None:
        pairs = _best_pairs(pairs.where("is_first").drop("position", "is_first"), best)
    # A request that comes twice is matched once.
    return pairs.join(_small(requests.distinct(), chosen.few), ["word", "next"]).drop("word", "next")


def _best_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The best ``n`` texts of each pair; of pairs that begin a longer request all, as their texts have yet to be compared.

    A pair is one request of two words, so this is its rank. Each task cuts its own texts before the shuffle.
    """
    score = frequency(F.col("hits") * 2, F.col("total_words").cast("bigint"))
    alone = F.when(F.col("is_longer"), F.col("text_id"))
    scored = pairs.withColumns({"matching_words_frequency": score, "_alone": alone})
    return rank_top(scored, n, "word", "next", "_alone").select("text_id", "total_words", "word", "next", "hits")


def _hits_of_many(index: DataFrame, chosen: RequestSet, n: int, mode: str) -> DataFrame:
    """Hits of requests of several words that are too many to be held by the driver program; of two words the best ``n``."""
    if mode == "exact":
        starts = _written(_phrase_starts(index, chosen, n))
    else:
        starts = _written(_phrase_starts(index, chosen).where("is_first"))
    of_two = F.col("n") == 2
    parts = []
    if mode == "exact":
        words = F.col("hits") * 2
        total = F.col("total_words").cast("bigint")
        parts.append(
            starts.where(of_two).select(
                "seq_id",
                "text_id",
                "hits",
                words.alias("matching_words"),
                total.alias("total_words"),
                frequency(words, total).alias("matching_words_frequency"),
            )
        )
        starts = starts.where(~of_two)
    asked = chosen.distinct.where(F.size("hashes") > (2 if mode == "exact" else 1))
    parts.append(_hits(_places_of_pairs(index, chosen, starts.select("text_id", "seq_id", "total_words"), asked), mode))
    return reduce(DataFrame.unionByName, parts)


def _places_of_pairs(index: DataFrame, chosen: RequestSet, matched: DataFrame, asked: DataFrame) -> DataFrame:
    """Matches of the requests ``asked`` with ``places``, each joined with the postings of its own words."""
    requests = _small(asked.dropDuplicates(["seq_id"]), chosen.few)
    wanted = F.explode(F.array_distinct(F.transform("hashes", _word))).alias("word")
    words = _written(matched.join(requests, "seq_id").select("text_id", "seq_id", "total_words", wanted))
    place = F.xxhash64("text_id", "word")
    postings = chosen.of_bins(index).select("text_id", _word(F.col("hash")).alias("word"), "positions")
    postings = thinned(postings, place, words, place, words.count())
    held = words.join(postings, ["text_id", "word"]).groupBy("text_id", "seq_id").agg(
        F.max("total_words").alias("total_words"), F.collect_list(F.struct("word", "positions")).alias("held")
    )
    sequence = F.transform("hashes", _word)
    return held.join(requests, "seq_id").select("seq_id", "hashes", "text_id", "total_words", places(F.col("held"), sequence).alias("places"))


def posting_lookup(index: DataFrame, sequences: DataFrame, bins: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, alias, text_id, positions, total_words): the postings of each request.

    A request with a word that the index lacks has none.
    """
    chosen = RequestSet(sequences, bins)
    known = chosen.drivers(*chosen.counts(index, vocabulary))[0].select("seq_id", "hashes")
    words = chosen.fan_out(known).select("query_id", F.posexplode(F.array_distinct("hashes")).alias("alias", "hash"))
    return (
        chosen(index)
        .join(_small(words, chosen.pinned), "hash")
        .select("query_id", "alias", "text_id", "positions", "total_words")
    )


def all_words_filter(index: DataFrame, sequences: DataFrame, bins: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, text_id, total_words): texts that hold every distinct word of a request."""
    chosen = RequestSet(sequences, bins)
    matched = match_words(index, chosen, vocabulary).select("seq_id", "text_id", "total_words")
    return chosen.fan_out(matched).select("query_id", "text_id", "total_words")


def rank_top(hits: DataFrame, n: int, *key: str) -> DataFrame:
    """Top n per request, or other key, by frequency, then text_id; ``rank`` counts from 1."""
    order = Window.partitionBy(*(key or ("query_id",))).orderBy(F.desc("matching_words_frequency"), F.asc("text_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _hits(matched: DataFrame, mode: str) -> DataFrame:
    """(seq_id, text_id, hits, matching_words, total_words, matching_words_frequency) with at least one hit."""
    staged = matched.select(
        "seq_id",
        "text_id",
        F.col("total_words").cast("bigint").alias("total_words"),
        F.size("hashes").alias("n"),
        "places",
        aliases(F.col("hashes")).alias("_sequence"),
    )
    hits = exact_hits(F.col("places"), F.col("_sequence"))
    if mode == "run":
        staged = run_hits(staged, "places", "_sequence", "_runs")
        hits = F.when(F.col("n") == 1, F.size(F.get("places", F.lit(0)))).otherwise(F.col("_runs"))
    counted = settle(staged, hits=hits.cast("bigint")).where(F.col("hits") > 0)
    words = F.col("hits") * F.col("n")
    return counted.select(
        "seq_id",
        "text_id",
        "hits",
        words.alias("matching_words"),
        "total_words",
        frequency(words, F.col("total_words")).alias("matching_words_frequency"),
    )


def _single_hits(index: DataFrame, chosen: RequestSet, n: int) -> DataFrame:
    """Hits of requests of one word: every posting of the word is a result by itself, so no text is gathered.

    Where requests are many the postings of a word are cut to its best ``n`` before they are joined.
    """
    asked = chosen.distinct.select("seq_id", F.get("hashes", F.lit(0)).alias("hash"))
    hits = F.size("positions").cast("bigint")
    total = F.col("total_words").cast("bigint")
    found = chosen(index).select(
        "hash",
        "text_id",
        hits.alias("hits"),
        hits.alias("matching_words"),
        total.alias("total_words"),
        frequency(hits, total).alias("matching_words_frequency"),
    )
    if not chosen.few:
        found = rank_top(found, n, "hash")
    return found.join(_small(asked, chosen.few), "hash").select("seq_id", "text_id", *HIT_COLUMNS)


def _ranked(index: DataFrame, chosen: RequestSet, n: int, mode: str, vocabulary: DataFrame | None) -> DataFrame:
    """(query_id, rank, text_id, hits, ...): ranked texts of each request."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    single, several = chosen.part(True), chosen.part(False)
    parts = []
    if single is not None:
        parts.append(_single_hits(index, single, n))
    if several is not None and not several.pinned:
        parts.append(_hits_of_many(index, several, n, mode))
    elif several is not None or not parts:
        parts.append(_hits(match_texts(index, several or chosen, vocabulary), mode))
    # Each part is cut to its best before the shuffle by request.
    top = reduce(DataFrame.unionByName, [rank_top(part, n, "seq_id") for part in parts])
    return chosen.fan_out(top).select("query_id", "rank", "text_id", *HIT_COLUMNS)


def single_word_search(index: DataFrame, sequences: DataFrame, bins: int, n: int = 10, vocabulary: DataFrame | None = None) -> DataFrame:
    """Requests of one word: every position is a hit."""
    return _ranked(index, RequestSet(sequences.where(F.size("hashes") == 1), bins), n, "run", vocabulary)


def multi_word_search(index: DataFrame, sequences: DataFrame, bins: int, n: int = 10, vocabulary: DataFrame | None = None) -> DataFrame:
    """Requests of several words: runs of adjacent request words that begin or end with the sequence."""
    return _ranked(index, RequestSet(sequences.where(F.size("hashes") > 1), bins), n, "run", vocabulary)


def phrase_search(index: DataFrame, sequences: DataFrame, bins: int, n: int = 10, vocabulary: DataFrame | None = None) -> DataFrame:
    """Requests of any length: every occurrence of the exact sequence is a hit."""
    return _ranked(index, RequestSet(sequences, bins), n, "exact", vocabulary)


def search_hits(
    index: DataFrame,
    sequences: DataFrame,
    bins: int,
    n: int = 10,
    mode: str = "run",
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Requests of any length, in either mode, without the texts."""
    return _ranked(index, RequestSet(sequences, bins), n, mode, vocabulary)


class _Results:
    """Ranked hits, computed once: a local table if they are few, else a stored table.

    ``most`` is a bound on the number of hits where one is known; without a small one the hits are written first and
    counted then.
    """

    def __init__(self, hits: DataFrame, most: int | None, text_buckets: int | None):
        self.rows: list[dict] | None = None
        self.text_buckets = text_buckets
        if most is None or most > MAX_RESULTS:
            path, schema, writer = shared_folder(hits.sparkSession), hits.schema, hits.write
            if text_buckets is not None:
                dealt = hits.withColumn("_bucket", F.pmod("text_id", F.lit(text_buckets)).cast("int"))
                schema, writer = dealt.schema, dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket")
            writer.parquet(path)
            hits = hits.sparkSession.read.schema(schema).parquet(path)
            most = hits.count()  # from the footers
        if most <= MAX_RESULTS:
            table = hits.drop("_bucket").toArrow()
            hits, self.rows = hits.sparkSession.createDataFrame(table), table.to_pylist()
        self.hits, self.number = hits, most

    def parts(self, texts: DataFrame) -> list[tuple[DataFrame, DataFrame, bool]]:
        """(hits, texts, small): hits with the stretch of the text table that holds their texts.

        Few hits put their buckets and ids into the scan as values. Many are dealt by bucket into stretches that are
        small enough to be sent to the texts; only a stretch of a single bucket can be larger.
        """
        if self.rows is not None:
            ids = sorted({row["text_id"] for row in self.rows})
            if self.text_buckets is not None:
                texts = texts.where(F.col("text_bucket").isin(sorted({text_id % self.text_buckets for text_id in ids})))
            return [(self.hits, texts.where(F.col("text_id").isin(ids)), True)]
        if self.text_buckets is None:
            return [(self.hits, texts, self.number <= MAX_BROADCAST_RESULTS)]
        loads = sorted((row["_bucket"], row["count"]) for row in self.hits.groupBy("_bucket").count().collect())
        stretches: list[tuple[list[int], int]] = []
        for number, load in loads:
            if not stretches or stretches[-1][1] + load > MAX_BROADCAST_RESULTS:
                stretches.append(([], 0))
            held, total = stretches.pop()
            stretches.append((held + [number], total + load))
        return [
            (self.hits.where(F.col("_bucket").isin(held)), texts.where(F.col("text_bucket").isin(held)), load <= MAX_BROADCAST_RESULTS)
            for held, load in stretches
        ]


def _found_ids(results: _Results, texts: DataFrame) -> DataFrame:
    """(text_id): the texts of the hits that are stored. Only ids are read."""
    parts = [
        F.broadcast(hits.select("text_id").distinct()).join(stored.select("text_id"), "text_id")
        if small
        else hits.select("text_id").distinct().join(stored.select("text_id"), "text_id")
        for hits, stored, small in results.parts(texts)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else results.hits.select("text_id")


def _missing(results: _Results, texts: DataFrame) -> DataFrame:
    found = _found_ids(results, texts)
    if results.rows is not None:
        there = {row.text_id for row in found.collect()}
        gone = [(row["query_id"], row["text_id"]) for row in results.rows if row["text_id"] not in there]
        return results.hits.sparkSession.createDataFrame(gone, results.hits.select("query_id", "text_id").schema)
    return results.hits.join(found, "text_id", "left_anti").select("query_id", "text_id")


def missing_texts(hits: DataFrame, texts: DataFrame, text_buckets: int | None = None, most: int | None = None) -> DataFrame:
    """(query_id, text_id) of hits without a stored text."""
    return _missing(_Results(hits, most, text_buckets), texts)


def read_texts(
    hits: DataFrame, texts: DataFrame, text_buckets: int | None = None, require_all: bool = True, most: int | None = None
) -> DataFrame:
    """Hits with their stored texts: query_id, rank, scores, text_id, metadata, text.

    ``text_buckets`` names the bucket count of a stored text table, so only the buckets of the hits are
    read. With ``require_all`` a request with a missing text has no result, else the rows found stay.

    Hits are computed once. They go to the texts, stretch by stretch of the text table, and texts are not shuffled;
    only hits of a single bucket that are too many to broadcast are left to the planner.
    """
    results = _Results(hits, most, text_buckets)
    if require_all:
        lacking = _missing(results, texts).select("query_id").distinct()
        if results.rows is not None:
            lacks = {row.query_id for row in lacking.collect()}
            results.rows = [row for row in results.rows if row["query_id"] not in lacks]
            rows = [tuple(row[name] for name in results.hits.columns) for row in results.rows]
            results.hits = results.hits.sparkSession.createDataFrame(rows, results.hits.schema)
        else:
            results.hits = results.hits.join(lacking, "query_id", "left_anti")
    metadata = [name for name in texts.columns if name not in ("text_id", "text", "text_bucket", "batch_id")]
    parts = []
    for part, stored, small in results.parts(texts):
        content = stored.select(F.col("text_id").alias("_id"), F.struct(*metadata, "text").alias("_text"))
        joined = _small(part, small).join(content, F.col("text_id") == F.col("_id"))
        columns = [F.col("_text")[name].alias(name) for name in [*metadata, "text"]]
        parts.append(joined.select("query_id", "rank", *HIT_COLUMNS, "text_id", *columns))
    if not parts:
        return read_texts(results.hits.drop("_bucket"), texts, None, False, 0)
    return reduce(DataFrame.unionByName, parts)


def search(
    index: DataFrame,
    texts: DataFrame,
    requests: DataFrame,
    bins: int,
    n: int = 10,
    mode: str = "run",
    stopwords: Stopwords = None,
    normalize_stopwords: bool = False,
    digest: str = "sha256",
    vocabulary: DataFrame | None = None,
    text_buckets: int | None = None,
    require_all: bool = False,
) -> DataFrame:
    """Answer a table of requests: ranked texts with scores, metadata and text."""
    sequences = request_sequences(requests, stopwords, normalize_stopwords, digest)
    chosen = RequestSet(sequences, bins)
    hits = _ranked(index, chosen, n, mode, vocabulary)
    most = len(chosen.rows) * n if chosen.pinned else None
    return read_texts(hits, texts, text_buckets, require_all, most)


def search_summary(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, request, results, matched, message): every request, also those without a match."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    joined = requests.join(counts, "query_id", "left")
    number = F.coalesce(F.col("results"), F.lit(0).cast("bigint"))
    return joined.select(
        "query_id",
        "request",
        number.alias("results"),
        (number > 0).alias("matched"),
        F.when(number == 0, F.lit("No matching texts were found.")).alias("message"),
    )
