from collections import Counter

import numpy as np
import pandas as pd
import pytest

from wordloom.llm import line_dedup, queries
from wordloom.llm.components import forest

SF_DIR = "/root/testdata/sf0.001"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(documents):
    """{doc_id: (n_lines, removed lines)} by comparing all pairs of different lines; ids are unique and not null."""
    lines = [
        (doc_id, no, line.strip(" ").lower())
        for doc_id, text in sorted(documents)
        for no, line in enumerate((text or "").split("\n"))
        if line.strip(" \t\n\x0b\x0c\r")
    ]
    distinct = sorted({line for _, _, line in lines})
    sets = [line_dedup.shingles(line) for line in distinct]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and jaccard(a, b) >= 0.8
    ]
    root = dict(forest(links))
    group = {line: root.get(i, i) for i, line in enumerate(distinct)}
    seen, out = set(), {doc_id: (0, []) for doc_id, _ in documents}
    for doc_id, no, line in lines:
        n, removed = out[doc_id]
        out[doc_id] = (n + 1, removed + [no] * (group[line] in seen))
        seen.add(group[line])
    return out, links


def test_query_finds_what_brute_force_finds(spark):
    documents = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op3_line_dedup(spark, SF_DIR).collect()
    got = {row.doc_id: (row.n_lines, [int(x) for x in row.removed_lines.split(",") if x]) for row in rows}
    want, links = brute(documents)
    assert len(rows) == len(documents) and got.keys() == want.keys()
    missed = sum(got[doc_id] != want[doc_id] for doc_id in want)
    assert links and missed <= 0.01 * len(want)


BASE = "the quick brown fox jumps over the lazy dog while the band plays an old tune number "
NEAR = [BASE + str(i) for i in range(30)]
EDGES = [
    (1, "Alpha beta gamma delta.\n\n  alpha BETA gamma delta.  \nshort\nSHORT\nabc"), (2, None), (3, ""), (4, "\n \n\t\n"),
    (5, "\n".join(NEAR[:15])), (6, "\n".join(NEAR[15:])), (7, "abc\nab\na\nab"), (8, "ünï çode line of some length\nünï çode line of some length!"),
    (9, ("z" * 7 + " ") * 20_000 + "\nlast line of all"),
]


@pytest.mark.parametrize("max_bucket", [line_dedup.MAX_BUCKET, 4])
def test_edges_and_buckets_cut_into_blocks(spark, max_bucket):
    frame = spark.createDataFrame([(*row, 0) for row in EDGES], "doc_id bigint, text string, removed int")
    found = line_dedup.repeated_lines(frame, max_bucket=max_bucket).collect()
    assert {row.doc_id: (row.n_lines, row.removed) for row in found} == brute(EDGES)[0]
    clean = line_dedup.dedup_lines(frame, max_bucket=max_bucket)
    assert clean.columns == frame.columns
    texts = {row.doc_id: row.text for row in clean.collect()}
    assert texts[1] == "Alpha beta gamma delta.\n\nshort\nabc" and texts[2] is None and texts[3] == "" and texts[5] == NEAR[0] and texts[6] == ""


def test_equal_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "one line of text"), (1, "one line of text"), (1, "one line of text"), (1, "another one entirely")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((row.doc_id, row.n_lines, tuple(row.removed)) for row in line_dedup.repeated_lines(frame).collect())
    assert got == Counter({(None, 1, ()): 1, (1, 1, (0,)): 2, (1, 1, ()): 1})
    assert line_dedup.dedup_lines(frame).count() == 4
    assert line_dedup.repeated_lines(frame.limit(0)).count() == 0


def test_signatures_find_nearly_all_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    met = tried = 0
    for _ in range(400):
        letters = [chr(97 + int(x)) for x in draw.integers(0, 26, 200)]
        other = letters.copy()
        for place in draw.choice(200, 4, replace=False):
            other[place] = "#"
        a, b = "".join(letters), "".join(other)
        if jaccard(line_dedup.shingles(a), line_dedup.shingles(b)) >= 0.8:
            tried += 1
            keys, sketches = line_dedup.band_keys([a, b, "pad"])
            alike = ((int(sketches[0]) ^ int(sketches[1])) & (1 << 64) - 1).bit_count()
            met += bool((keys[0] == keys[1]).any()) and alike <= line_dedup.MAX_SKETCH_BITS
    assert tried > 100 and met / tried >= 0.98


def test_signatures_do_not_depend_on_the_batch(monkeypatch):
    lines = ["a", "abcd", "abcde", "x" * 50, "hello world of lines", "ünï", "last"]
    together = line_dedup.band_keys(lines)
    monkeypatch.setattr(line_dedup, "CHARACTERS", 1)
    apart = line_dedup.band_keys(lines)
    assert all(np.array_equal(one, other) for one, other in zip(together, apart))
    for i, line in enumerate(lines):
        keys, sketches = line_dedup.band_keys([line])
        assert np.array_equal(keys[0], together[0][i]) and sketches[0] == together[1][i]


def test_crowded_buckets_are_passed_on_and_cut_in_spark(spark):
    """The task of a crowded bucket makes one row per line, in every batch, and every two lines meet in a block."""
    n, most = 3000, 100
    frame = pd.DataFrame({"band_key": [7] * n + [8] * 2, "line_id": [*range(n), 1, 2], "sketch": 0})
    out = list(line_dedup._shared(most)(frame[i : i + 250] for i in range(0, n + 2, 250)))
    assert max(map(len, out)) <= 250 + most and sum(map(len, out)) == n + 2
    keyed = spark.range(n).selectExpr("explode(array(7L, 9L)) AS band_key", "id AS line_id", "0L AS sketch")
    blocks = {}
    for row in line_dedup.bucket_members(keyed.unionByName(keyed.limit(5)), most).collect():
        blocks.setdefault((row.bucket, row.block), set()).add(row.line_id)
    assert len({bucket for bucket, _ in blocks}) == 1 and max(map(len, blocks.values())) <= 4 * most
    met = {frozenset((a, b)) for lines in blocks.values() for a in lines if a < 40 for b in lines if a < b < 40}
    assert len(met) == 40 * 39 // 2


def test_numbers_of_shingles_are_exact():
    draw = np.random.default_rng(9)
    plain = ["".join(draw.choice(list("abc é"), draw.integers(0, 40))) for _ in range(60)]
    for lines in (plain, plain + ["日本語のテスト文です", "\0\0ab", "ab", "ab\0", "𝒳𝒴𝒵 wide", "日本"]):
        sets, values = [line_dedup.shingles(line) for line in lines], line_dedup.shingle_values(lines)
        assert [len(own) for own in sets] == [len(own) for own in values]
        for a, own in zip(sets, values):
            for b, other in zip(sets, values):
                assert len(a & b) == len(np.intersect1d(own, other))
                for least in (0.3, 0.8):
                    assert line_dedup.similar(own, other, least) == (jaccard(a, b) >= least)


def test_clashing_names_and_similarities_that_are_refused(spark):
    rows = [(1, "a line that is there twice", 1, 2, 3), (2, "a line that is there twice\nother words", 1, 2, 3)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _lost_id int, _lost_key int, _lost_lines int")
    clean = line_dedup.dedup_lines(frame)
    assert clean.columns == frame.columns and {row.doc_id: row.text for row in clean.collect()} == {1: rows[0][1], 2: "other words"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(frame, similarity=0.5)


@pytest.mark.parametrize("one_by_one", [0, 100])
def test_links_of_a_bucket_connect_what_brute_force_connects(monkeypatch, one_by_one):
    monkeypatch.setattr(line_dedup, "ONE_BY_ONE", one_by_one)
    draw = np.random.default_rng(one_by_one)
    for size in (0, 1, 2, 5, 60):
        lines = {}
        for i in range(size):
            text = list("the same beginning of many lines " * 2 + "kind %d" % draw.integers(0, 4) * 6)
            for place in draw.integers(0, len(text), draw.integers(0, 3)):
                text[place] = "#"
            lines[int(i * 7 % 61)] = "".join(text)
        sets = {line_id: line_dedup.shingles(line) for line_id, line in lines.items()}
        links = [(a, b) for a in sets for b in sets if a > b and jaccard(sets[a], sets[b]) >= 0.8]
        found = line_dedup.linked(lines, 0.8)
        assert dict(found) == dict(forest(links)) and len(found) == len(dict(found))


def test_small_groups_are_linked_together_as_one_by_one():
    """op3 finding: many small groups are compared at a time, larger ones alone; batches may cut any group."""
    draw = np.random.default_rng(5)
    rows = []
    for bucket in range(120):
        base = "".join(draw.choice(list("abc é’日"), draw.integers(1, 60)))
        for line_id in draw.choice(10**6, draw.integers(1, 7), replace=False).tolist():
            line = list(base)
            for place in draw.integers(0, len(line), draw.integers(0, 3)).tolist():
                line[place] = "#"
            rows.append((bucket // 2, bucket % 2, line_id, "".join(line)))
    want = []
    for bucket in range(120):
        want += line_dedup.linked({i: line for b, k, i, line in rows if (b, k) == divmod(bucket, 2)}, 0.8)
    frame = pd.DataFrame(rows, columns=["bucket", "block", "line_id", "line"])
    for size in (1, 7, len(frame)):
        cut = (frame[i : i + size].reset_index(drop=True) for i in range(0, len(frame), size))
        found = pd.concat(line_dedup._verified(0.8)(cut))
        assert want and sorted(want) == sorted(zip(found["left"].tolist(), found["right"].tolist()))
    few = frame[frame.groupby(["bucket", "block"])["line_id"].transform("size") <= 3]
    met = line_dedup.linked_groups((few["bucket"] * 2 + few["block"]).to_numpy(), np.sort(few["line_id"].to_numpy()), few["line"].tolist(), 0.8)
    assert len(met[0]) == len(met[1]) > 0


def test_rows_of_a_bucket_need_no_order_of_lines():
    """op3 finding: rows come by band key alone, and a line that many tasks have signed fills no bucket."""
    rows = [(1, 5, 0), (2, 9, 0), (2, 4, 0), (2, 9, 0), (3, 7, 0), *[(4, i % 3, 0) for i in range(40)], (5, 4, 0), (5, 9, 0)]
    frame = pd.DataFrame(rows, columns=["band_key", "line_id", "sketch"])
    for size in (1, 3, 100):
        out = pd.concat(line_dedup._shared(3)(frame[i : i + size] for i in range(0, len(frame), size)))
        assert set(out["block"]) == {0} and sorted(out["line_id"]) == [0, 1, 2, 4, 4, 9, 9]
        assert out["bucket"].nunique() == 2


def test_texts_are_split_once(spark, monkeypatch):
    """op3 finding: lines are written once and read by the signatures, the texts and the places."""
    frame = spark.createDataFrame([(1, "a line that is there twice\nother"), (2, "a line that is there twice")], "doc_id bigint, text string")
    tables = []
    links = line_dedup.line_links
    monkeypatch.setattr(line_dedup, "line_links", lambda lines, **options: (tables.append(lines), links(lines, **options))[1])
    found = line_dedup.repeated_lines(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString() + tables[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    assert sorted((row.doc_id, row.n_lines, row.removed) for row in found.collect()) == [(1, 2, []), (2, 1, [0])]


@pytest.mark.parametrize("bits", [64, line_dedup.MAP_BITS])
def test_groups_of_a_home_are_compared_together(monkeypatch, bits):
    """op3 finding: a text comes once for all groups of its home; lines that share no group are not compared."""
    monkeypatch.setattr(line_dedup, "MAP_BITS", bits)
    draw = np.random.default_rng(bits)
    rows, want = [], {}
    for home in range(60):
        base = "".join(draw.choice(list("abc é’日"), draw.integers(1, 90)))
        lines = {}
        for line_id in draw.choice(10**6, draw.integers(2, 9), replace=False).tolist():
            line = list(base)
            for place in draw.integers(0, len(line), draw.integers(0, 3)).tolist():
                line[place] = "#"
            lines[line_id] = "".join(line)
        groups = {line_id: draw.choice(4, draw.integers(1, 4), replace=False) for line_id in lines}
        sets = {line_id: line_dedup.shingles(line) for line_id, line in lines.items()}
        links = [(a, b) for a in sets for b in sets if a > b and set(groups[a]) & set(groups[b]) and jaccard(sets[a], sets[b]) >= 0.8]
        want.update({(home, node): root for node, root in forest(links)})
        rows += [(home, line_id, groups[line_id], line) for line_id, line in lines.items()]
    frame = pd.DataFrame(rows, columns=["home", "line_id", "groups", "line"])
    for size in (1, 7, len(frame)):
        cut = (frame[i : i + size].reset_index(drop=True) for i in range(0, len(frame), size))
        found = pd.concat(line_dedup._verified(0.8, ["home"])(cut))
        assert want and sorted(zip(found["left"].tolist(), found["right"].tolist())) == sorted((node, root) for (_, node), root in want.items())


def test_small_groups_with_the_same_smallest_line_have_one_home():
    """op3 finding: homes hold no more lines than a bucket; larger groups have a home of their own."""
    rows = [(1, 5, 0), (1, 7, 0), (2, 5, 0), (2, 8, 0), (3, 6, 0), (3, 8, 0), *[(4, i, 0) for i in range(5, 10)]]
    frame = pd.DataFrame(rows, columns=["band_key", "line_id", "sketch"])
    out = pd.concat(line_dedup._shared(24, 12)([frame]))
    homes = {tuple(sorted(some["line_id"])): set(some["home"]) for _, some in out.groupby("bucket")}
    assert homes.pop((5, 6, 7, 8, 9)) == set(out["bucket"][out["line_id"] == 9])
    assert homes == {(5, 7): {5}, (5, 8): {5}, (6, 8): {6}}


def test_a_text_moves_once_for_the_groups_of_a_home(spark, monkeypatch):
    """op3 finding: rows with text are one for each line and home, not one for each group."""
    lines = [f"{'these words stand in all of the lines ' * 4}{'and some do not ' * (i % 3)}{i}" for i in range(40)]
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "line_id bigint, line string")
    sets = [line_dedup.shingles(line) for line in lines]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if jaccard(a, b) >= 0.8]
    found = line_dedup.line_links(frame).collect()
    assert links and dict(forest((row.left, row.right) for row in found)) == dict(forest(links))

    def compared(similarity, by=("bucket", "block")):
        def seen(batches):
            for rows in batches:
                yield pd.DataFrame({"left": rows[by[0]], "right": rows["line_id"]})

        return seen

    monkeypatch.setattr(line_dedup, "_verified", compared)
    rows = [(row.left, row.right) for row in line_dedup.line_links(frame).collect()]
    assert len(rows) == len(set(rows)) and all(home <= line_id for home, line_id in rows)
