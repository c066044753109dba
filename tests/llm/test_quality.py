import re
from collections import Counter

from wordloom.llm import queries, quality

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + j for i, window in enumerate(windows) if counts[window] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    base_failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    lost = sum(len("".join(WORD.findall(line))) for line in lines if fails(line))
    chars = sum(map(len, words))
    return (
        len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base_failed,
        lost, not base_failed and lost * 100 <= chars * 50,
    )


def fails(line):
    end = line.rstrip(" \t\n\x0b\x0c\r")[-1:]
    noise, separators = len(re.findall(quality.NOISE, line)), len(re.findall(quality.SEPARATORS, line))
    boilerplate = len(line) <= 200 and re.search(quality.BOILERPLATE, line.lower())
    unfinished = not re.match(quality.TERMINAL, end) and not re.search(quality.SENTENCE_END, line)
    return bool(unfinished or separators >= 2 or noise * 100 > len(line) * 10 or boilerplate)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op4_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    assert {row.doc_id: tuple(row)[1:] for row in rows} == {doc_id: brute(text) for doc_id, text in texts.items()}
    assert {row.kept for row in rows} == {True, False}


EDGES = [
    None, "", " \n\t ", "a", "a b c d e f g h i j", "One two three four five six seven eight nine ten.",
    "a b c d e " * 30, "a " * 5000 + ".", "x.\n\nx.\n x.\nx.", "\x0ba\x0cb\rc d\n", "ein Satz über 😀 Grüße, der ganz ist und reicht. " * 2,
    "A sentence that is whole, followed by one. And this is cut off in the", "No end in\nsight of any line\nhere. Or\n",
    "Menu | Home | About | Contact\nThe rest of this is a plain sentence of some more words.",
]


def test_edges_repeats_and_clashing_columns(spark):
    rows = [(None if i == 3 else i, text, "s", i) for i, text in enumerate(EDGES + EDGES)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n_chars bigint")
    judged = quality.quality_rules(frame).collect()
    got = Counter(tuple(row[name] for name in quality.RESULTS if name != "clean_text") for row in judged)
    assert got == Counter(brute(text) for text in EDGES + EDGES)
    kept = quality.keep_clean(frame)
    assert kept.columns == frame.columns
    assert all(row.n_chars == len(row.text) for row in kept.collect())
    assert quality.quality_rules(frame.limit(0)).count() == 0


def test_failing_lines_go(spark):
    text = "A first line that is fine and long enough to count.\nHome | News | Contact\nAll rights reserved.\nA last one that ends well, too."
    clean = spark.createDataFrame([(1, text)], "doc_id bigint, text string").transform(quality.keep_clean).first().text
    assert clean == "A first line that is fine and long enough to count.\nA last one that ends well, too."


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = queries.op4_quality_rules(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
