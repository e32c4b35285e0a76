"""The pipeline's stages take effect, on the rows each predecessor kept."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from colex.llm import jaccard, secrets  # noqa: E402

from . import data  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_each_stage_on_awkward_rows(spark):
    docs = data.clashing(spark.createDataFrame(data.documents(), data.SCHEMA)).cache()
    groups = {r[0]: r[2] for r in data.jaccard([r for r in data.documents() if r[0] is not None][:60])}
    first = pipeline.near_duplicates(spark, docs, SF).collect()
    kept = [r["doc_id"] for r in first if r["doc_id"] is not None]
    assert len(kept) == len(set(kept)) and {groups[k] for k in kept if k in groups} <= set(kept)
    clean = pipeline.redact_secrets(spark, docs, SF).collect()
    assert len(clean) == docs.count() and all(not secrets.spans_of(r["text"]) for r in clean)
    mixed = pipeline.mix_sources(spark, docs, SF)
    most = mixed.groupBy("doc_id", "text").count().agg({"count": "max"}).first()[0]
    assert most <= 4  # twice each of two repeated rows
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages_one_by_one(spark):
    """The rows of run() against the stages, each over the collected rows of the one before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = jaccard.join_components(docs).where("doc_id = component_id").toPandas()
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES:
        before, docs = docs.count(), stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == pipeline.COLUMNS
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
            assert 0 < len(rows) and (name in ("secret_scan", "source_mix") or len(rows) < before)
    out = pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(out[key].itertuples(index=False, name=None))
    assert {"sequence_id", "offset"} <= set(out.columns) and out.groupby("sequence_id")["length"].sum().max() <= 1024
    assert set(out["doc_id"]) <= set(good["doc_id"]) | set(out["doc_id"][out["doc_tokens"] < 5])


def test_near_duplicates_link_from_four_fifths_on(spark):
    """Pairs with a block of their text replaced: a five-word similarity of 0.80 to 0.85 links, less doesn't."""
    rows, gone = [], set()
    for i, block in enumerate(range(6, 30)):
        words = [f"p{i}w{j}" for j in range(204)]
        changed = words[:90] + [f"p{i}c{j}" for j in range(block)] + words[90 + block :]
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(changed), "en", "s", 0)]
        a, b = (data.shingles(r[1], 5) for r in rows[-2:])
        if 100 * len(a & b) >= 80 * len(a | b):
            gone.add(2 * i + 1)
    between = [i for i in gone if 100 * len(data.shingles(rows[i][1]) & data.shingles(rows[i - 1][1])) < 85 * len(data.shingles(rows[i][1]) | data.shingles(rows[i - 1][1]))]
    assert between and len(gone) < 24
    kept = {r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, data.SCHEMA), SF).collect()}
    assert kept == {r[0] for r in rows} - gone


@pytest.mark.parametrize("few", [0, 1000])
def test_near_duplicates_judge_rows_by_their_texts(spark, monkeypatch, few):
    """Null and shared ids, repeated rows, texts without words; verdicts broadcast and shuffled."""
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", few)
    text = lambda name, changed=False: " ".join(f"{name}{j}" for j in range(100)) + (" x" if changed else "")
    rows = [
        (None, text("a"), "en", "s", 0), (None, text("a", True), "en", "s", 0), (None, text("b"), "en", "s", 0), (4, text("b", True), "en", "s", 0), (5, text("c"), "en", "s", 0), (5, text("d"), "en", "s", 0),
        (6, text("c", True), "en", "s", 0), (7, text("e"), "en", "s", 0), (7, text("e"), "en", "s", 0), (7, text("e"), "de", None, 0), (8, None, "en", "s", 0), (8, None, "en", "s", 0), (9, " ", "en", "s", 0),
    ]
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, data.SCHEMA).repartition(3), SF).collect()]
    one = [t for i, t in kept if i is None]
    assert len(one) == 1 and one[0] in (text("a"), text("a", True))
    expected = [(4, text("b", True)), (5, text("c")), (5, text("d")), (7, text("e")), (8, None), (8, None), (9, " ")]
    assert sorted(((i, t) for i, t in kept if i is not None), key=str) == sorted(expected, key=str)


def test_texts_are_read_once_to_be_joined_and_sent_in_few_rows(spark):
    """Work that grows with the input alone: one pass over the texts, and a row for a key partition and 4 MB of text."""
    from pyspark.sql import functions as F

    passed = spark.sparkContext.accumulator(0)

    def text(i):
        passed.add(1)
        return " ".join(f"w{i}x{j}" for j in range(1300))

    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.udf(text, "string")("id").alias("text"))
    assert jaccard.join_components(docs, k=5).where("n_shingles = 1296 AND component_id = doc_id").count() == 300
    assert passed.value == 300
    keyed = docs.select("doc_id", F.hash("doc_id").cast("long").alias("text_key"), "text")
    sent = jaccard._sent(keyed, 5, jaccard.key_parts(keyed)).collect()
    assert len(sent) == 2 + jaccard.key_parts(keyed) and jaccard.key_parts(keyed) == 4
    entries = sum((len(r["payload"]) - 9 - (n := int.from_bytes(r["payload"][1:9], "little")) * jaccard._TAG.itemsize) // 8 for r in sent if r["payload"][0] == 1)
    assert entries == 300 * 1296


def test_more_verdicts_than_before_meet_texts_where_they_are(spark, monkeypatch):
    """200,001 verdicts, null and shared ids among them: no join, and the rows that a join gives."""
    from pyspark.sql import functions as F

    key = F.xxhash64(F.concat(F.lit("t"), F.col("id")))
    verdict = spark.range(0, 200_001).select(F.when(F.col("id") % 1000 != 0, F.col("id") % 50_000).alias("id"), key.alias("key"), (F.col("id") % 3 == 0).alias("stays")).cache()
    text = F.concat(F.lit("t"), (F.col("id") * 7 + F.col("id") % 2).cast("string"))
    keyed = spark.range(0, 40_000).select(F.when(F.col("id") % 400 != 0, (F.col("id") * 7) % 50_000).alias("doc_id"), text.alias("text")).withColumn("key_", F.xxhash64("text"))
    keyed = keyed.union(keyed.limit(3)).cache()
    here = pipeline.with_verdicts(keyed, verdict)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]
    monkeypatch.setattr(pipeline, "BROADCAST_ROWS", 0)
    there = pipeline.with_verdicts(keyed, verdict)
    assert "ShuffledHashJoin" in there._jdf.queryExecution().executedPlan().toString()
    rows = [sorted(map(tuple, x.select("doc_id", "key_", "stays").collect()), key=str) for x in (here, there)]
    assert rows[0] == rows[1] and {r[2] for r in rows[0]} == {None, True, False} and len(rows[0]) == 40_003
    monkeypatch.undo()
    assert pipeline.with_verdicts(keyed, verdict.limit(0)).where("stays IS NULL").count() == 40_003
