from collections import Counter

from test_decontaminate import brute as contaminated
from test_mixing import targets_of
from test_quality import brute as judged
from test_simhash import brute as grouped
from test_simhash import fingerprint

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if i == 4:
            place = docs.metadataColumn("_metadata")
            docs_in_order = docs.orderBy(place["file_name"], place["row_index"])
        before = [row.asDict() for row in (docs_in_order if i == 4 else docs).collect()]
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [row.asDict() for row in docs.collect()]
        assert i == 4 or docs.columns == columns
        ids = Counter(row["doc_id"] for row in after)
        if i == 0:
            assert set(ids) == {row["doc_id"] for row in before if judged(row["text"])[-1]}
        elif i == 1:
            groups = {component for _, _, component in grouped([(row["doc_id"], row["text"]) for row in before])}
            assert ids == Counter(groups) and len({fingerprint(row["text"]) for row in after}) == len(after)
        elif i == 2:
            found = contaminated([(row["doc_id"], row["text"]) for row in before], benchmark)
            assert set(ids) == {doc_id for doc_id, *_, hit in found if not hit}
        elif i == 3:
            sizes, targets = targets_of([(row["doc_id"], row["text"], row["source"]) for row in before])
            assert max(ids.values()) <= 2
            for source in sizes:
                own = [len(row["text"].split()) for row in before if row["source"] == source]
                mixed = sum(len(row["text"].split()) for row in after if row["source"] == source)
                assert abs(mixed - targets[source]) <= max(own)
        else:
            assert len(after) == len(before) and {row["shard"] for row in after} <= set(range(40))
            for shard in range(40):
                # ``before`` was read in the order of training; a document may be read twice.
                slots = sorted((row["slot"], row["doc_id"]) for row in after if row["shard"] == shard)
                own = {row["doc_id"] for row in after if row["shard"] == shard}
                assert [slot for slot, _ in slots] == list(range(len(slots)))
                assert [doc_id for _, doc_id in slots] == [row["doc_id"] for row in before if row["doc_id"] in own]


def test_run_gives_the_last_stage(spark):
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.columns[-5:] == ["size", "text_crc32", "shard", "slot", "grown_shard"]
    assert result.count() > 0
