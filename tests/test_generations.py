"""Generations of the index and the text store: what a format writes, what it leaves alone, and what readers see."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wordloom import Layout, append_batch, format_index, index_corpus, open_index, open_texts, open_vocabulary
from wordloom.operators.postings import postings, vocabulary
from wordloom.plans import indexing, manifest
from wordloom.plans.indexing import append_postings, open_staging, open_touched, to_merge
from wordloom.sources.state import BEGINNING, read_state

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts_of(spark, first, last, schema="text_id long, text string"):
    rows = [(i, " ".join(WORDS[(i * 7 + j * j) % 20] + str(i % 3) * (j % 2) for j in range(8))) for i in range(first, last)]
    return spark.createDataFrame(rows, schema)


def rows(frame):
    columns = ["bin", "hash", "text_id", "positions", "total_words"]
    return sorted((r.bin, r.hash, r.text_id, tuple(r.positions), r.total_words) for r in frame.select(columns).collect())


def counts(frame):
    return sorted(tuple(row) for row in frame.select("bin", "hash", "texts", "occurrences").collect())


def files(path):
    """{file: time of its last change} of the Parquet files below a folder."""
    return {
        os.path.join(folder, name): os.stat(os.path.join(folder, name)).st_mtime_ns
        for folder, _, names in os.walk(path)
        for name in names
        if name.endswith(".parquet")
    }


def folders(path):
    return sum(1 for _, _, names in os.walk(path) if any(name.endswith(".parquet") for name in names))


def check_equal(spark, layout, texts):
    want = postings(texts, layout.bins)
    assert rows(open_index(spark, layout)) == rows(want)
    assert counts(open_vocabulary(spark, layout)) == counts(vocabulary(want))
    stored = sorted((r.text_id, r.text, r.text_bucket) for r in open_texts(spark, layout).collect())
    assert stored == sorted((r.text_id, r.text, r.text_id % layout.text_buckets) for r in texts.collect())


def test_merge_rule():
    assert to_merge({}, 10) == set()
    assert to_merge({1: 1000}, 10) == set()
    assert to_merge({1: 1000, 2: 5, 3: 6}, 10) == set()
    assert to_merge({1: 1000, 2: 5, 3: 6, 4: 7}, 10) == {2, 3, 4}
    assert to_merge({1: 1000, 2: 5, 3: 6, 4: 7}, 10, full=6) == set()
    assert to_merge({1: 1000, 2: 5}, 10, forced=[1]) == {1}
    # Small ones carry on into the next size.
    assert to_merge({1: 4, 2: 4, 3: 4, 4: 16, 5: 16, 6: 16, 7: 10**6}, 4) == {1, 2, 3, 4, 5, 6}


def test_generations_stay_few_and_rewriting_too():
    sizes, written = {}, 0
    for i in range(1000):
        merged = to_merge(sizes, 10)
        total = 10 + sum(sizes.pop(generation) for generation in merged)
        sizes[i] = total
        written += total
        assert len(sizes) <= 3 * 6
    assert sum(sizes.values()) == 10_000 and written <= 10_000 * 7


def test_small_batch_leaves_the_base_alone(spark, layout):
    base = texts_of(spark, 0, 400)
    index_corpus(spark, layout, {"base": base})
    before = {table: files(table) for table in (layout.index, layout.vocabulary, layout.texts)}
    index_corpus(spark, layout, {"small": texts_of(spark, 400, 403)})
    for table, held in before.items():
        after = files(table)
        assert held.items() <= after.items()
        new = sum(os.path.getsize(name) for name in after if name not in held)
        assert len(after) > len(held) and new < sum(os.path.getsize(name) for name in held)
    assert len(manifest.current(spark, layout).index) == 2
    check_equal(spark, layout, texts_of(spark, 0, 403))


def test_merged_equals_rebuilt(spark, tmp_path):
    layout = Layout(str(tmp_path / "many"), 3, 2)
    index_corpus(spark, layout, {"base": texts_of(spark, 0, 150)})
    live = []
    for i in range(5):
        index_corpus(spark, layout, {f"b{i}": texts_of(spark, 150 + 3 * i, 153 + 3 * i)})
        version = manifest.current(spark, layout)
        live.append(len(version.index))
        assert sum(version.index.values()) == open_index(spark, layout).count()
    assert live == [2, 3, 4, 2, 3]  # the fourth small one takes in the three before it
    check_equal(spark, layout, texts_of(spark, 0, 165))
    assert rows(open_staging(spark, layout)) == rows(open_index(spark, layout))
    batches = {(r.batch_id, r.text_id) for r in open_staging(spark, layout).select("batch_id", "text_id").collect()}
    assert ("b0", 150) in batches and ("b4", 164) in batches and ("base", 149) in batches


def test_replaced_batch_of_a_merged_generation(spark, layout):
    for i in range(4):
        index_corpus(spark, layout, {f"b{i}": texts_of(spark, 10 * i, 10 * i + 10)})
    assert len(manifest.current(spark, layout).index) == 1
    append_batch(layout, texts_of(spark, 11, 13), "b1")
    # Texts and staging follow at once, the index and its vocabulary with the next format.
    left = texts_of(spark, 0, 40).where("text_id NOT BETWEEN 10 AND 19 OR text_id BETWEEN 11 AND 12")
    assert open_texts(spark, layout).count() == 32
    assert rows(open_staging(spark, layout)) == rows(postings(left, 7))
    assert rows(open_index(spark, layout)) == rows(postings(texts_of(spark, 0, 40), 7))
    index_corpus(spark, layout, {})
    check_equal(spark, layout, left)


def test_reader_keeps_its_version_during_and_after_a_format(spark, layout):
    first = texts_of(spark, 0, 20)
    index_corpus(spark, layout, {"a": first})
    want = rows(open_index(spark, layout))
    index, words, texts = open_index(spark, layout), open_vocabulary(spark, layout), open_texts(spark, layout)
    index_corpus(spark, layout, {"a": texts_of(spark, 5, 9)})
    assert rows(index) == want and counts(words) == counts(vocabulary(postings(first, 7))) and texts.count() == 20
    check_equal(spark, layout, texts_of(spark, 5, 9))


@pytest.mark.parametrize("killed", ["vocabulary", "write_texts", "commit"])
def test_killed_format_leaves_the_old_version(spark, layout, monkeypatch, killed):
    index_corpus(spark, layout, {"a": texts_of(spark, 0, 12)})
    append_batch(layout, texts_of(spark, 12, 20), "b")
    append_batch(layout, texts_of(spark, 0, 6), "a")

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(manifest if killed == "commit" else indexing, killed, die)
    with pytest.raises(KeyboardInterrupt):
        format_index(spark, layout, BEGINNING)
    monkeypatch.undo()
    old = postings(texts_of(spark, 0, 12), 7)
    assert rows(open_index(spark, layout)) == rows(old) and counts(open_vocabulary(spark, layout)) == counts(vocabulary(old))
    index_corpus(spark, layout, {})
    check_equal(spark, layout, texts_of(spark, 0, 20).where("text_id NOT BETWEEN 6 AND 11"))


def test_killed_append_does_not_count(spark, layout, monkeypatch):
    index_corpus(spark, layout, {"a": texts_of(spark, 0, 4)})

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(manifest, "register", die)
    with pytest.raises(KeyboardInterrupt):
        append_batch(layout, texts_of(spark, 4, 9), "b")
    monkeypatch.undo()
    assert open_texts(spark, layout).count() == 4 and open_touched(spark, layout).where("batch_id = 'b'").count() == 0
    index_corpus(spark, layout, {"b": texts_of(spark, 4, 6)})
    check_equal(spark, layout, texts_of(spark, 0, 6))


def test_append_that_outlasts_formats_is_not_lost(spark, layout):
    slow = manifest.Batch("slow", manifest.new_write(), manifest.current(spark, layout).number, manifest.micros(indexing.now()))
    indexing._stage(layout, postings(texts_of(spark, 50, 53), 7), slow)
    for i in range(3):
        index_corpus(spark, layout, {f"b{i}": texts_of(spark, i, i + 1)})
    manifest.register(spark, layout, slow)
    format_index(spark, layout, BEGINNING)
    want = postings(texts_of(spark, 0, 3).union(texts_of(spark, 50, 53)), 7)
    assert rows(open_index(spark, layout)) == rows(want)
    assert format_index(spark, layout, BEGINNING) == []


def test_folders_do_not_grow_with_batches(spark, tmp_path):
    found = []
    for name, batches in (("one", 1), ("many", 6)):
        layout = Layout(str(tmp_path / name), 3, 2)
        cut = [0, *range(30 // batches, 30, 30 // batches)][:batches] + [30]
        for i in range(batches):
            append_batch(layout, texts_of(spark, cut[i], cut[i + 1]), str(i))
        assert folders(layout.staging) == 1
        index_corpus(spark, layout, {})
        version = manifest.current(spark, layout)
        live = [f"{layout.index}/_generation={g}" for g in version.index] + [f"{layout.texts}/_generation={g}" for g in version.texts]
        found.append((sum(map(folders, live)), open_texts(spark, layout).rdd.getNumPartitions(), len(open_texts(spark, layout).inputFiles())))
        check_equal(spark, layout, texts_of(spark, 0, 30))
    assert found[0][0] == found[1][0] and found[1][2] <= 2 * found[0][2]


def test_what_no_version_names_is_emptied(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "SLOTS", 3)
    layout = Layout(str(tmp_path / "library"), 2, 2)
    for i in range(5):
        index_corpus(spark, layout, {"a": texts_of(spark, i, i + 2)})
    assert os.path.isdir(f"{layout.index}/_generation=1") and folders(f"{layout.index}/_generation=1/") <= 1
    for generation in (1, 2):
        assert spark.read.parquet(f"{layout.index}/_generation={generation}").count() == 0
    assert spark.read.parquet(f"{layout.staging}/_epoch=0").count() == 0
    assert len(os.listdir(layout.manifest)) == 3
    check_equal(spark, layout, texts_of(spark, 4, 6))


def test_log_goes_back_to_the_last_state_only(spark, layout):
    for i in range(4):
        index_corpus(spark, layout, {str(i): texts_of(spark, i, i + 1)})
        assert {r.batch_id for r in open_touched(spark, layout).select("batch_id").distinct().collect()} <= {str(i - 1), str(i)}
    append_batch(layout, texts_of(spark, 9, 10), "new")
    state = read_state(spark, layout.state)[1]
    logged = open_touched(spark, layout)
    since = {r.batch_id for r in logged.where(F.col("generation_timestamp") > F.lit(state).cast("timestamp")).collect()}
    assert since == {"new"}
    paths = {path for path in logged.inputFiles()}
    assert not any("_epoch=0/" in path or "_epoch=1/" in path for path in paths)


def test_log_keeps_one_row_per_batch_and_word(spark, layout):
    early = datetime(2026, 1, 1, tzinfo=timezone.utc)
    table = spark.createDataFrame([(1, "a b a"), (2, "a")], "text_id long, text string")
    append_postings(layout, postings(table, 7), "1", early)
    append_postings(layout, postings(table.where("text_id = 2"), 7), "2", early + timedelta(seconds=1))
    logged = [(r.batch_id, r.bin, r.generation_timestamp.microsecond) for r in open_touched(spark, layout).collect()]
    assert len(logged) == 3 and {batch_id for batch_id, _, _ in logged} == {"1", "2"}


def test_rare_hash_skips_row_groups(spark, layout):
    many = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("text_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    append_postings(layout, postings(many, 1), "1")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", str(1 << 18))
    try:
        format_index(spark, layout, BEGINNING)
    finally:
        hadoop.unset("parquet.block.size")
    everything = open_index(spark, layout).count()

    def read(value):
        found = open_index(spark, layout).where(F.col("hash") == value)
        return len(found.collect()), scanned(found)

    known = open_index(spark, layout).select("hash").orderBy("hash").limit(3).collect()[1].hash
    number, touched = read(known)
    assert number == 1 and touched < everything / 2
    # Inside the bounds of a row group but not in it: the bloom filter tells.
    skipped = [read(known[:-4] + f"{i:04x}")[1] for i in range(5)]
    assert sum(skipped) < touched


def scanned(frame):
    """Rows that the executed scan of a collected frame handed on."""
    stack, total = [frame._jdf.queryExecution().executedPlan()], 0
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
    return total


def test_metadata_of_batches_is_united(spark, layout):
    append_batch(layout, texts_of(spark, 0, 2).withColumn("title", F.lit("t")), "a")
    append_batch(layout, texts_of(spark, 2, 4).withColumn("_write", F.lit(1)), "b")
    index_corpus(spark, layout, {"c": texts_of(spark, 4, 6)})
    found = open_texts(spark, layout)
    assert found.columns == ["text_id", "title", "_write", "text", "batch_id", "text_bucket"] or set(found.columns) >= {"title", "text"}
    assert found.where("title = 't'").count() == 2 and found.count() == 6
    with pytest.raises(ValueError, match="title"):
        append_batch(layout, texts_of(spark, 6, 8).withColumn("title", F.lit(1)), "d")


def test_empty_library(spark, layout):
    assert open_index(spark, layout).count() == 0 and open_vocabulary(spark, layout).count() == 0
    assert open_staging(spark, layout).count() == 0 and open_touched(spark, layout).count() == 0
    assert index_corpus(spark, layout, {"none": texts_of(spark, 0, 1).where("false")})[0] == 0
    assert open_index(spark, layout).count() == 0 and open_texts(spark, layout).count() == 0
    for texts in (texts_of(spark, 0, 2), texts_of(spark, 0, 1).where("false"), texts_of(spark, 3, 4)):
        index_corpus(spark, layout, {"none": texts})
        check_equal(spark, layout, texts)


def test_filters_reach_the_files_of_every_generation(spark, layout):
    for i in range(2):
        index_corpus(spark, layout, {str(i): texts_of(spark, 10 * i, 10 * i + 10)})
    assert len(manifest.current(spark, layout).index) == 2
    some = open_vocabulary(spark, layout).where("bin IN (2, 3) AND hash IN ('a', 'b')")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bin" in plan and "In(hash, [a,b])" in plan
    few = open_index(spark, layout).where("bin = 2").select("hash")
    assert "ReadSchema: struct<hash:string>" in few._jdf.queryExecution().executedPlan().toString()
