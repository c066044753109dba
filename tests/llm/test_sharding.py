import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wordloom.llm import queries, sharding

SF_DIR = "/root/testdata/sf0.01"


def test_query_follows_its_law(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op8_sharding(spark, SF_DIR).collect()
    assert Counter(row.doc_id for row in rows) == Counter(list(texts))
    slots = defaultdict(list)
    for row in rows:
        data = texts[row.doc_id].encode()
        assert (row["size"], row.text_crc32, row.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert row.grown_shard in (row.shard, 40)
        slots[row.shard].append(row.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert any(row.grown_shard == 40 for row in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, queries.op8_sharding(spark, SF_DIR).collect()))


def placed(spark, weights, n=20_000, shape=(5, 4)):
    shard = sharding.shard_of(F.col("id").cast("string"), weights, *shape)
    return {row.id: row.shard for row in spark.range(n).select("id", shard.alias("shard")).collect()}


def test_shares_follow_weights_and_weightless_shards_stay_empty(spark):
    weights = [1.0, 2.0, 0.0, 4.0, 1.0, 0.0, 0.0, 2.0]
    counts = Counter(placed(spark, weights, shape=(2, 2)).values())
    for shard, weight in enumerate(weights):
        assert abs(counts[shard] - 20_000 * weight / sum(weights)) < 500
        assert weight or not counts[shard]


def test_movement_stays_in_changed_subtrees(spark):
    weights = [1.0] * 40
    before, heavier = placed(spark, weights), placed(spark, [*weights[:-1], 3.0])
    moved = [(before[k], heavier[k]) for k in before if before[k] != heavier[k]]
    # The last shard's rack and region grew: keys only move within or into its region (shards 20 to 39).
    assert moved and all(to >= 20 for _, to in moved)
    grown = placed(spark, [*weights, 1.0])
    assert {to for k, to in grown.items() if to != before[k]} == {40}
    assert abs(sum(to == 40 for to in grown.values()) - 20_000 / 41) < 150


def test_edges(spark):
    rows = [(1, "a", 9), (1, "a", 9), (1, "b", 9), (None, None, 9), (None, "", 9), (2, "ü" * 100_000, 9)] + [(i, "hot", 9) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    got = sharding.shard(frame).collect()
    assert len(got) == len(rows)
    assert {r["size"] for r in got if r.row.text is None} == {16} and {r.text_crc32 for r in got if r.row.text is None} == {None}
    assert len({r.shard for r in got if r.row.doc_id == 1 and r.row.text in "ab"}) == 1
    assert len({r.shard for r in got if r.row.doc_id is None}) == 1
    slots = defaultdict(list)
    for row in got:
        slots[row.shard].append(row.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert sharding.shard(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), [0.0])


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_slots_in_the_order_of_files(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr("wordloom.llm.numbering.BLOCK_ROWS", block)
    rows = [(i % 90, "hot" if i % 3 else str(i), 1, 2) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, _metadata int, file int").repartition(5).write.parquet(path)
    stored = spark.read.parquet(path)
    got = sharding.shard(stored, weights=[1.0, 0.0, 3.0], in_order=True).collect()
    place = stored.metadataColumn("_metadata")
    want = stored.select("doc_id", "text", place["file_name"].alias("f"), place["row_index"].alias("r")).orderBy("f", "r").collect()
    shard = {row.row.doc_id: row.shard for row in got}
    for number in (0, 2):
        own = sorted((row.slot, row.row.doc_id, row.row.text) for row in got if row.shard == number)
        assert [slot for slot, *_ in own] == list(range(len(own)))
        assert [tuple(entry[1:]) for entry in own] == [(row.doc_id, row.text) for row in want if shard[row.doc_id] == number]
    assert sharding.shard(spark.read.parquet(path).limit(600).where("false"), in_order=True).count() == 0
