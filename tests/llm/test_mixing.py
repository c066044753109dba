import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.llm import mixing, queries
from wordloom.llm.numbering import hashed_order, pieces_for, running

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights, share, repeats):
    """{source: target} by pouring the budget out step by step."""
    budget, left, targets = sum(sizes.values()) * share / 100, set(sizes), {}
    while left:
        weight = sum(weights[s] for s in left)
        over = [s for s in left if budget * weights[s] / weight >= sizes[s] * repeats]
        if not over:
            return targets | {s: budget * weights[s] / weight for s in left}
        for s in over:
            targets[s] = float(sizes[s] * repeats)
            budget -= targets[s]
            left.remove(s)
    return targets


def sources_in_order(names):
    return sorted(names, key=lambda name: (name is None, name or ""))


def targets_of(rows, repeats=2):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    weights = {name: (5, 2, 1)[i % 3] for i, name in enumerate(sources_in_order(sizes))}
    return sizes, water_fill(sizes, weights, 150, repeats)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute_taken(rows):
    """Counter of (doc_id, size, source_size, taken)."""
    sizes, targets = targets_of(rows)
    out = Counter()
    for source in sizes:
        own = [row for row in rows if row[2] == source]
        name = lambda row: ":".join(["-" if row[0] is None else str(row[0]), "-" if row[1] is None else md5(row[1])])
        own.sort(key=lambda row: (md5(name(row))[:13], row[0] is not None, row[0]))
        before, taken = 0, []
        for row in own:
            size = len(WORD.findall(row[1] or ""))
            goal = int(targets[source] + 1e-9)
            words = sum(max(0, min(goal - times * sizes[source] - before, size)) for times in range(2))
            taken.append((row[0], size, sizes[source], words))
            before += size
        out.update(taken)
    return out


def test_query_equals_brute_force_and_meets_targets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = queries.op9_mixing(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == brute_taken(rows)
    sizes, targets = targets_of(rows)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in targets.values()}
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, queries.op9_mixing(spark, SF_DIR).collect()))


ROWS = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(40)] + [(None, "a b c", None), (None, "a b c", None), (5, None, "s1"), (6, "", "é")]
ROWS += [(100 + i, "hot text " * 3, "zz") for i in range(300)] + [(7, "w " * 4000, "big")]


def test_edges_and_kept_columns(spark):
    frame = spark.createDataFrame([(*row, 1, 2) for row in ROWS], "doc_id bigint, text string, source string, size int, row int")
    mixed = mixing.mix(frame).cache()
    assert Counter((r.row.doc_id, r["size"], r.source_size, r.taken) for r in mixed.collect()) == brute_taken(ROWS)
    sizes, targets = targets_of(ROWS)
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += r.taken
    assert all(abs(taken[source] - targets[source]) < 1 for source in sizes)
    ordered = mixing.in_training_order(mixed)
    assert ordered.columns == frame.columns
    whole = sum(len(WORD.findall(r.text)) for r in ordered.collect())
    assert abs(whole - sum(targets.values())) <= sum(max(len(WORD.findall(t or "")) for _, t, s in ROWS if s == source) for source in sizes)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_table_of_sources_beyond_the_bound(spark, monkeypatch):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert Counter((r.row.doc_id, r["size"], r.source_size, r.taken) for r in mixing.mix(frame).collect()) == brute_taken(ROWS)


@pytest.mark.parametrize("knots", [*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (0.8, 0.0), (1.0, 1.0))])
def test_positions_invert_the_integral(spark, knots):
    def demand(t):
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            if t > t0:
                end = min(t, t1)
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                done += (end - t0) * (w0 + w) / 2
        return done

    rows = spark.range(0, 1001).select((F.col("id") / 1000).alias("share")).withColumn("time", mixing.time_of(F.col("share"), knots))
    got = rows.orderBy("share").collect()
    assert all(abs(demand(r.time) / demand(1.0) - r.share) < 1e-9 for r in got)
    assert all(a.time <= b.time + 1e-12 for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        mixing.pieces(((0.0, 1.0), (0.9, 1.0)))


def test_running_sums_over_many_pieces(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 3).alias("g")).withColumn("order", hashed_order(F.col("id")))
    got = running(frame, ["g"], "order", ["id"], {"before": F.col("id"), "n": F.lit(1)}, 10_000_000).collect()
    for g in range(3):
        own, so_far = sorted((r for r in got if r.g == g), key=lambda r: r.order), 0
        for n, row in enumerate(own):
            assert (row.before, row.n) == (so_far, n)
            so_far += row.id
    assert pieces_for(10_000_000) == 4096 and pieces_for(0) == 128
