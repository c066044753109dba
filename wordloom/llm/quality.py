"""Line-first cleaning: lines that break a rule go, then documents that lose too much text.

Everything happens inside the row of a document with DataFrame functions; nothing is shuffled.

Defined results: a null or empty text has no words and fails; a text without line breaks is one line;
lines without words are neither judged nor lost; equal rows are judged alike; null ids are carried along;
an input column named like a result gives way to it. Arrays are as long as the text they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.expressions import SPACED_WORD, WHITE_SPACE, let, places, total, unused, with_results, words_of

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20

#: The end of a sentence inside a line; a line with one is prose even if its own end is cut off.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]* "
#: Ends of a finished line.
TERMINAL = r"[.!?…:;\"'”’»)\]。！？]"
#: Marks that part the entries of a menu.
SEPARATORS = r"[|»›•·]"
MAX_SEPARATORS = 2
#: Characters of decoration and emphasis; a line with a larger share of them is none of prose.
NOISE = r"[#*$%&|<>!~^_=+]"
MAX_NOISE_PERCENT = 10
BOILERPLATE = (
    r"all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookie (policy|settings)|"
    r"(enable|requires) javascript|lorem ipsum|skip to (main )?content|click here|sign up for|subscribe to our|"
    r"share (this|on) (facebook|twitter|whatsapp)|log ?in to|powered by"
)
MAX_BOILERPLATE_CHARS = 200
MAX_LOST_PERCENT = 50


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text, first occurrences included.

    Windows are compared by 64-bit hashes. Only a text with an equal pair of hashes is sorted.
    """
    hashes = F.transform(
        places(F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])
    )

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            def twice(j: Column) -> Column:
                own = F.get(pairs, j)["h"]
                before = F.when(j > 0, F.get(pairs, F.greatest(j - 1, F.lit(0)))["h"])
                after = F.get(pairs, j + 1)["h"]
                return F.coalesce(own == before, F.lit(False)) | F.coalesce(own == after, F.lit(False))

            return F.sort_array(F.transform(F.filter(places(F.size(pairs)), twice), lambda j: F.get(pairs, j)["i"]))

        def count(starts: Column) -> Column:
            reach = F.transform(
                starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - at, F.lit(WINDOW)))
            )
            return total(reach)

        return let(let(pairs, starts), count)

    def judged(found: Column) -> Column:
        alike = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(alike, F.lit(0).cast("bigint")).otherwise(covered(found))

    return let(hashes, judged)


def line_fails(line: Column) -> Column:
    """A line that is unfinished, a menu, decoration or boilerplate."""
    noisy = F.regexp_count(line, F.lit(NOISE)) * 100 > F.char_length(line) * MAX_NOISE_PERCENT
    menu = F.regexp_count(line, F.lit(SEPARATORS)) >= MAX_SEPARATORS
    boilerplate = (F.char_length(line) <= MAX_BOILERPLATE_CHARS) & F.lower(line).rlike(BOILERPLATE)
    unfinished = ~F.right(F.rtrim(line, F.lit(WHITE_SPACE)), F.lit(1)).rlike(TERMINAL) & ~line.rlike(SENTENCE_END)
    return unfinished | menu | noisy | boilerplate


def judge(text: Column, max_lost_percent: int = MAX_LOST_PERCENT) -> Column:
    """The verdict on a text and the text without the lines that fail, as a struct."""
    given = F.coalesce(text, F.lit(""))

    def judged(lines: Column) -> Column:
        with_words = F.filter(lines["lines"], lambda line: line["has_word"])
        failing = F.filter(with_words, lambda line: line["fails"])
        kept_lines = F.filter(lines["lines"], lambda line: ~line["fails"])
        return F.struct(
            (F.size(with_words) - F.size(F.array_distinct(F.transform(with_words, lambda line: line["line"])))).cast("bigint").alias("n_dup_lines"),
            F.array_join(F.transform(kept_lines, lambda line: line["line"]), "\n").alias("clean_text"),
            total(
                F.transform(failing, lambda line: F.char_length(F.array_join(words_of(line["line"]), "")).cast("bigint"))
            ).alias("lost_chars"),
        )

    def told(line: Column) -> Column:
        has_word = line.rlike(SPACED_WORD)
        return F.struct(line.alias("line"), has_word.alias("has_word"), (has_word & line_fails(line)).alias("fails"))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def verdict(parts: Column) -> Column:
        words, lines = parts["words"], parts["lines"]
        n_words, repeated = words["n_words"], words["n_repeat_words"]
        base_failed = (n_words < MIN_WORDS) | (repeated * 100 > n_words * MAX_REPEATED_PERCENT)
        lost = lines["lost_chars"]
        return F.struct(
            n_words.alias("n_words"),
            words["word_chars"].alias("word_chars"),
            F.regexp_count(given, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            lines["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            lost.alias("lost_chars"),
            (~base_failed & (lost * 100 <= words["word_chars"] * max_lost_percent)).alias("kept"),
            lines["clean_text"].alias("clean_text"),
        )

    lines = F.struct(F.transform(F.split(given, "\n", -1), told).alias("lines"))
    parts = F.struct(let(words_of(given), counted).alias("words"), let(lines, judged).alias("lines"))
    return let(parts, verdict)


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text",
)


def quality_rules(documents: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents with the results of ``judge`` as columns."""
    name = unused(documents, "_verdict")
    judged = documents.select("*", F.explode(F.array(judge(F.col(text), max_lost_percent))).alias(name))
    return with_results(judged, **{key: F.col(name)[key] for key in RESULTS}).drop(name)


def keep_clean(documents: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The documents that pass, without the lines that fail; ``n_chars`` follows the text where there is one."""
    name = unused(documents, "_verdict")
    judged = documents.select("*", F.explode(F.array(judge(F.col(text), max_lost_percent))).alias(name))
    clean = F.col(name)["clean_text"]
    new = {text: clean, "n_chars": F.char_length(clean).cast("bigint")}
    columns = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns]
    return judged.where(F.col(name)["kept"]).select(*columns)
