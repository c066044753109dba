"""URL filters: host names are split into words, then a naive Bayes model scores the words of host and path.

Words of hosts: the labels of all hosts (without the top-level one) are cut at hyphens and digits; every distinct
piece is split by Viterbi into the most likely sequence of words, under unigram counts of the words in all pages and
in the labelled addresses. Only parts of pieces meet those counts, in a join, so no dictionary has to fit a task.
Verdicts: the longest fitting rule decides, and where none fits the sign of the multinomial naive Bayes log odds.
The model counts the words of a table of labelled addresses, by default those of the pages that a rule decides, and of a
seed list. A word counts once per labelled host and verdict, so pages of one host weigh no more than one; words that a rule
is written in only repeat the rule and are not learned from the pages that it decides. Weights are whole numbers of
10^-9, so sums do not depend on the order of the rows.

Defined results: a null address or one without ``://`` has empty host and path, no rule and no words, so the prior
decides (allow); words that no labelled address has weigh nothing; equal rows have equal results; other columns, and
those named like a result, are carried along or give way. Pages without text still count their addresses.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import lower_ascii, places, unused, with_results, words_of, written

LONGEST_WORD = 20
#: Occurrences that a word of the labelled addresses adds to the counts of the pages, as a part of all words.
LABELLED_SHARE = 1e-4
#: The share of addresses expected to be bad.
BAD_SHARE = 0.2
SMOOTHING = 1.0
#: Weights and scores are sums of whole numbers of this size.
UNIT = 1e-9
#: The scores of all hosts, and of all paths, are broadcast below this many bytes.
MAX_BROADCAST_BYTES = 32 << 20
LETTERS = r"[a-z\x{80}-\x{10FFFF}]+"

#: The seed list: phrases of addresses to block, and of others. None is a host name of the pages.
BAD = (
    "cheap meds", "buy pills online", "online pharmacy", "discount meds", "casino bonus", "poker jackpot",
    "free slots", "sports betting", "bet win cash", "adult video", "hot sex cams", "porn tube",
    "xxx movies", "escort dating", "link farm", "click farm", "ad tracker", "track pixel click",
    "banner ads", "popup ads", "malware download", "free download crack", "keygen warez", "payday loan", "fast cash loan",
    "win free prize", "replica watches", "weight loss miracle",
)
GOOD = (
    "news", "daily news", "music lessons", "family history", "science journal", "open library", "public library", "history museum",
    "city council", "weather report", "school of music", "university research", "community forum", "photo gallery",
    "book review", "recipe kitchen", "travel guide", "garden notes", "software docs", "help center", "about us",
    "health clinic", "art and design", "film review", "sports club", "video lectures", "download manual", "loan calculator",
    "online course", "free software", "track and field", "watch repair", "cash flow report",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an address."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw_host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.get(lower_ascii(F.array(raw_host)), F.lit(0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule (verdict, host/path) that fits."""
    rule = verdict = F.lit(None).cast("string")
    for told, name in sorted(rules, key=lambda entry: len(entry[1])):  # later ones, the longer, come first
        of_host, slash, of_path = name.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(slash + of_path)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def host_pieces(host: Column) -> Column:
    """What is to be split into words: runs of letters in all labels but the last."""
    labels = F.split(host, r"\.")
    return words_of(F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), "."), LETTERS)


def path_words(path: Column) -> Column:
    return words_of(F.lower(path), LETTERS)


def labelled_words(bad: Sequence[str] = BAD, good: Sequence[str] = GOOD) -> dict[str, int]:
    """How often each word occurs in the labelled addresses."""
    counts: dict[str, int] = {}
    for line in (*bad, *good):
        for word in line.split():
            counts[word] = counts.get(word, 0) + 1
    return counts


def rule_labelled(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, bad, named) of the pages that a rule decides; ``named`` are the words the rule is written in."""
    rule, told = rule_of(*parts(F.col(url)), rules)
    found = pages.select(F.col(url).alias("url"), (told == "block").alias("bad"), rule.alias("rule")).where(F.col("rule").isNotNull())
    return found.select("url", "bad", path_words(F.col("rule")).alias("named"))


def seed_counts(bad: Sequence[str] = BAD, good: Sequence[str] = GOOD) -> list[tuple[str, int, int]]:
    """(word, n_bad, n_good) of the seed list."""
    counts: dict[str, list[int]] = {}
    for side, lines in enumerate((bad, good)):
        for line in lines:
            for word in line.split():
                counts.setdefault(word, [0, 0])[side] += 1
    return [(word, *pair) for word, pair in sorted(counts.items())]


def word_weights(labelled: DataFrame, host_words: DataFrame, seeds: list[tuple[str, int, int]]) -> DataFrame:
    """(word, weight): the log odds each known word adds, by multinomial naive Bayes, in whole ``UNIT``.

    ``labelled`` has (host, path, bad, named), ``host_words`` (host, host_words) of all its hosts.
    """
    split = host_words.select(F.col("host").alias("of_host"), "host_words")
    hosts = labelled.select("host", "bad", "named").distinct().join(split, F.col("host") == F.col("of_host"))
    in_hosts = hosts.select("host", "bad", F.explode(F.array_except("host_words", "named")).alias("word"))
    in_paths = labelled.select("host", "bad", F.explode(F.array_except(path_words(F.col("path")), F.col("named"))).alias("word"))
    seen = in_hosts.unionByName(in_paths).distinct()
    told = seen.groupBy("word").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good"))
    if seeds:
        told = told.unionByName(labelled.sparkSession.createDataFrame(seeds, "word string, n_bad bigint, n_good bigint"))
    counts = written(told.groupBy("word").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good")))
    sums = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bad"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    words, n_bad, n_good = (float(x) for x in sums)
    shift = log((n_good + SMOOTHING * words) / (n_bad + SMOOTHING * words)) if words else 0.0
    odds = F.log((F.col("n_bad") + SMOOTHING) / (F.col("n_good") + SMOOTHING)) + F.lit(shift)
    return written(counts.select("word", F.round(odds / UNIT).cast("bigint").alias("weight")))


def viterbi(piece: str, counts: dict[tuple[int, int], float], total: float, longest: int = LONGEST_WORD) -> list[str]:
    """The most likely words of a piece; ``counts`` has the counts of its parts by begin and end.

    An unknown part of n characters counts as 10 / 10^n occurrences. Ties go to the longer last word.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        options = []
        for begin in range(max(0, end - longest), end):
            count = counts.get((begin, end), 0.0)
            chance = log(count / total) if count > 0 else log(10.0 / total) - (end - begin) * log(10.0)
            options.append((best[begin][0] + chance, -begin))
        score, begin = max(options)
        best.append((score, -begin))
    words, end = [], len(piece)
    while end > 0:
        begin = best[end][1]
        words.append(piece[begin:end])
        end = begin
    return words[::-1]


def segmented(pieces: DataFrame, unigrams: DataFrame, labelled: dict[str, int]) -> DataFrame:
    """(piece, words) of the distinct strings ``piece``, under (word, count) and the labelled words."""
    total = unigrams.agg(F.coalesce(F.sum("count"), F.lit(0.0)).cast("double")).first()[0]
    extra = max(total * LABELLED_SHARE, 1.0)
    total += extra * sum(labelled.values())
    begin, end = F.col("begin"), F.col("begin") + F.col("length")
    cut = (
        pieces.select("piece", F.explode(places(F.char_length("piece"))).alias("begin"))
        .select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.char_length("piece") - begin))).alias("length"))
        .select("piece", begin.alias("begin"), end.alias("end"), F.substring("piece", begin + 1, F.col("length")).alias("word"))
    )
    known = unigrams.select("word", F.col("count").cast("double").alias("count"))
    found = cut.select("word").distinct().join(known, "word")
    gathered = (
        cut.join(found, "word", "left")
        .groupBy("piece")
        .agg(F.collect_list(F.when(F.col("count").isNotNull(), F.struct("begin", "end", "count"))).alias("found"))
    )

    @F.pandas_udf("array<string>")
    def split(piece: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, entries in zip(piece, found):
            counts = {(int(one["begin"]), int(one["end"])): float(one["count"]) for one in entries}
            for word, times in labelled.items():
                at = text.find(word)
                while at >= 0:
                    place = (at, at + len(word))
                    counts[place] = counts.get(place, 0.0) + extra * times
                    at = text.find(word, at + 1)
            out.append(viterbi(text, counts, total))
        return pd.Series(out)

    return gathered.select("piece", split("piece", "found").alias("words"))


def split_hosts(hosts: DataFrame, unigrams: DataFrame, labelled: dict[str, int]) -> DataFrame:
    """(host, host_words) of the distinct strings ``host``; hosts without a piece are left out."""
    pieces = hosts.select("host", F.posexplode(host_pieces(F.col("host"))).alias("place", "piece"))
    words = segmented(pieces.select("piece").distinct(), unigrams, labelled)
    gathered = pieces.join(words, "piece").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("split"))
    return gathered.select("host", F.flatten(F.transform("split", lambda one: one["words"])).alias("host_words"))


def summed(keyed: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, score) of (key, words): the sum of the words' weights, for keys with a known word."""
    opened = keyed.select("key", F.explode("words").alias("word")).groupBy("key", "word").count()
    return opened.join(weights, "word").groupBy("key").agg(F.sum(F.col("count") * F.col("weight")).alias("score"))


def _few(frame: DataFrame, size: Column, max_bytes: int) -> DataFrame:
    """To be broadcast if it is measured to be small; in a join of many rows the planner splits the frequent ones."""
    few = frame.agg(F.coalesce(F.sum(size + 64), F.lit(0))).first()[0] <= max_bytes
    return F.broadcast(frame) if few else frame


def page_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, count) over the text of all pages, tags left out; single letters count too."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "<[^>]*>", " "))
    words = pages.select(F.explode_outer(words_of(plain, LETTERS)).alias("word")).where(F.col("word").isNotNull())
    return words.where(F.char_length("word") <= LONGEST_WORD).groupBy("word").count()


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    html: str = "html",
    bad: Sequence[str] = BAD,
    good: Sequence[str] = GOOD,
    bad_share: float = BAD_SHARE,
    max_bytes: int = MAX_BROADCAST_BYTES,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule``, ``verdict``, ``host_words`` and ``log_odds``.

    ``labelled`` has (url, bad) and, if wanted, ``named``, words not to be learned from the address. Without it the pages
    that a rule decides are the labelled addresses. ``bad`` and ``good`` are phrases that are counted besides.
    """
    if labelled is None:
        labelled = rule_labelled(pages, rules, url)
    host, path = parts(F.col("url"))
    named_words = F.col("named") if "named" in labelled.columns else F.array().cast("array<string>")
    labelled = labelled.select(host.alias("host"), path.alias("path"), "bad", named_words.alias("named")).where(F.col("bad").isNotNull())
    labelled = written(labelled.distinct())
    host, path = parts(F.col(url))
    names = [unused(pages, name) for name in ("_host", "_path", "_words", "_score", "_key", "_of_path", "_path_score")]
    own_host, own_path, own_words, own_score, key, of_path, path_score = names
    named = pages.withColumns({own_host: host, own_path: path})
    hosts = written(named.select(F.col(own_host).alias("host")).unionByName(labelled.select("host")).distinct())
    seeds = seed_counts(bad, good)
    split = written(split_hosts(hosts, written(page_words(pages, html)), labelled_words(bad, good)))
    weights = word_weights(labelled, split, seeds)
    host_scores = summed(split.select(F.col("host").alias("key"), F.col("host_words").alias("words")), weights)
    scores = written(split.join(host_scores.withColumnRenamed("key", "scored"), F.col("host") == F.col("scored"), "left").drop("scored"))
    scores = scores.select(F.col("host").alias(key), F.col("host_words").alias(own_words), F.col("score").alias(own_score))
    paths = named.select(F.col(own_path).alias("key")).where("key <> ''").distinct()
    path_scores = written(summed(paths.select("key", path_words(F.col("key")).alias("words")), weights))
    path_scores = path_scores.select(F.col("key").alias(of_path), F.col("score").alias(path_score))
    # A host may hold any share of the pages, so pages stay where they are if there are few hosts.
    scores = _few(scores, F.octet_length(key) + F.octet_length(F.array_join(own_words, " ")), max_bytes)
    path_scores = _few(path_scores, F.octet_length(of_path), max_bytes)
    joined = named.join(scores, F.col(own_host) == F.col(key), "left").join(path_scores, F.col(own_path) == F.col(of_path), "left")
    added = F.coalesce(own_score, F.lit(0)) + F.coalesce(path_score, F.lit(0))
    odds = F.lit(log(bad_share / (1 - bad_share))) + added * F.lit(UNIT)
    rule, told = rule_of(F.col(own_host), F.col(own_path), rules)
    verdict = F.coalesce(told, F.when(odds > 0, F.lit("block")).otherwise(F.lit("allow")))
    results = with_results(
        joined,
        host=F.col(own_host),
        path=F.col(own_path),
        rule=rule,
        verdict=verdict,
        host_words=F.coalesce(own_words, F.array().cast("array<string>")),
        log_odds=odds,
    )
    return results.drop(*names)
