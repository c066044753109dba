import hashlib
import re
from collections import Counter

import pytest

from wordloom.llm import decontaminate, queries

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(documents, benchmark):
    items = {}
    for item_id, text in benchmark:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            items.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    lengths = {len(window) for window in items}
    out = []
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (of := items.get(tuple(w[i : i + n]))) is not None:
                    found |= of
                    hit.update(range(i, i + n))
        ids = ",".join(sorted(str(item) for item in found if item is not None))
        out.append((doc_id, len(w), len(hit), len(ids.split(",")) if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return Counter(out)


def digest(found):
    return Counter(
        (r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
        for r in found.collect()
    )


def table(spark, name, *columns):
    return [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*columns).collect()]


def test_query_equals_brute_force(spark):
    want = brute(table(spark, "documents", "doc_id", "text"), table(spark, "benchmark", "item_id", "text"))
    got = Counter(tuple(row) for row in queries.op5_benchmark_decontamination(spark, SF_DIR).collect())
    assert got == want
    assert any(row[-1] for row in got)


TEN = "one two three four five six seven eight nine ten"
DOCUMENTS = [
    (1, f"before {TEN} eleven twelve after"), (1, f"before {TEN} eleven twelve after"), (1, "short Item, here"), (2, None), (3, ""),
    (None, f"{TEN.upper()}!"), (None, TEN), (4, "x " * 3000 + TEN + " x" * 3000), (5, "lonely"), (6, "Ünï çode short item"),
    (7, f"{TEN} {TEN} {TEN}"), (8, "...\n--"),
]
ITEMS = [(10, TEN + " eleven"), (11, TEN + " eleven twelve"), (12, "short item"), (13, None), (14, "..."), (15, "lonely"), (16, TEN), (16, TEN)]


@pytest.mark.parametrize("max_bytes", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_edges_on_both_join_paths(spark, max_bytes):
    documents = spark.createDataFrame([(*row, 1) for row in DOCUMENTS], "doc_id bigint, text string, n_words int")
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.contamination(documents, benchmark, max_bytes=max_bytes)
    assert digest(found) == brute(DOCUMENTS, ITEMS)
    kept = decontaminate.remove(documents, benchmark, max_bytes=max_bytes)
    assert kept.columns == documents.columns
    clean = {(doc_id, n_hit == 0): None for doc_id, _, n_hit, *_ in brute(DOCUMENTS, ITEMS)}
    assert sorted(row.doc_id for row in kept.collect()) == sorted(doc_id for doc_id, is_clean in clean if is_clean)


def test_empty_tables(spark):
    documents = spark.createDataFrame(DOCUMENTS, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contamination(documents.limit(0), benchmark).count() == 0
    none = decontaminate.contamination(documents, benchmark.limit(0)).collect()
    assert len(none) == len(DOCUMENTS) and not any(row.contaminated for row in none)


def test_spans_are_cut_out(spark):
    documents = spark.createDataFrame([(1, f"Keep, {TEN}; This too."), (2, "Nothing here.")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, TEN)], "item_id bigint, text string")
    kept = {row.doc_id: row.text for row in decontaminate.remove(documents, benchmark, "spans").collect()}
    assert kept == {1: "Keep, This too.", 2: "Nothing here."}
    clashing = documents.selectExpr("*", "1 AS _hit_id", "2 AS _hit_key", "3 AS _spans", "4 AS key", "5 AS spans")
    for mode, want in (("documents", {2}), ("spans", {1, 2})):
        found = decontaminate.remove(clashing, benchmark, mode)
        assert found.columns == clashing.columns and {row.doc_id for row in found.collect()} == want
    with pytest.raises(ValueError):
        decontaminate.remove(documents, benchmark, "other")
