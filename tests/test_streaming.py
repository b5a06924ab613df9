import datetime
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusengine.operators import ann, dedup, memory
from corpusengine.streaming import dedup as stream_dedup
from corpusengine.streaming import memory as stream_memory
from corpusengine.streaming import registry, sync
from tests.conftest import SF, rows


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None
    assert not query.isActive


def test_sync_restart_adds_only_new(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / p) for p in ("in", "index", "cp"))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    centres = ann.ivf_train(vectors, 8)
    vectors.where("id < 200").unionByName(
        spark.createDataFrame([(-1, None)], "id BIGINT, embedding ARRAY<FLOAT>")
    ).write.parquet(source)
    start = lambda: sync.sync_stream(spark, source, vectors.schema, index, checkpoint, centres, 1)
    run(start())
    assert sync.watermark(spark, index) == 199
    vectors.where("id >= 200").repartition(3).write.mode("append").parquet(source)
    run(start())
    run(start())
    got = sync.read_index(spark, index)
    assert spark.read.parquet(index).count() == vectors.count()
    assert rows(got, "id", "cell") == rows(ann.ivf_assign(vectors, centres), "id", "cell")


def test_exact_stream_equals_batch(spark, tmp_path):
    texts = ["a sentence long enough to count", "short", "short", "a sentence long enough to count", "another sentence, long enough"]
    spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text STRING").parquet(str(tmp_path / "in"))
    q = (
        stream_dedup.exact_stream(stream, "text").writeStream.format("memory").queryName("exact_out")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run(q)
    assert rows(spark.table("exact_out")) == sorted([(t,) for t in set(texts)] + [("short",)])


def test_near_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.split("text", "\n").alias("s"))
    lines = docs.select("doc_id", F.posexplode("s").alias("pos", "text")).where("text <> ''")
    schema = lines.schema
    folder = str(tmp_path / "in")
    paths = [str(tmp_path / p) for p in ("registry", "out", "cp")]
    # the second part arrives in a second run
    for part in ("doc_id < 100", "doc_id >= 100"):
        lines.where(part).coalesce(1).write.mode("append").parquet(folder)
        run(stream_dedup.near_stream(spark, folder, schema, *paths, max_files=1))
    numbered = dedup.exact(lines, "text", ["doc_id", "pos"]).withColumn("id", F.col("doc_id") * 100_000 + F.col("pos"))
    long = dedup.signatures(numbered.where("length(text) >= 20"), "text")
    gone = dedup.near_duplicates(long.select("id", "signature"))
    want = numbered.join(gone, "id", "left_anti")
    got = spark.read.parquet(paths[1])
    assert gone.count() > 0
    assert rows(got, "doc_id", "pos") == rows(want, "doc_id", "pos")


def test_near_batches_with_merged_runs_and_replays_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.split("text", "\n").alias("s")).where("doc_id < 60")
    lines = docs.select("doc_id", F.posexplode("s").alias("pos", "text")).where("text <> ''")
    # Copies with one word more come in every later batch, the last batch is empty.
    lines = lines.unionByName(lines.where("doc_id % 12 = 0").select((F.col("doc_id") + 61).alias("doc_id"), "pos", F.concat("text", F.lit(" a")).alias("text")))
    folder, out = str(tmp_path / "registry"), str(tmp_path / "out")
    bounds = [0, 20, 62, 200, 201]
    for batch, (a, b) in enumerate(zip(bounds, bounds[1:])):
        part = lines.where(F.col("doc_id").between(a, b - 1))
        for _ in range(2 if batch in (1, 3) else 1):  # sent again
            stream_dedup.near_batch(part, batch, folder, out, fan=2)
    numbered = dedup.exact(lines, "text", ["doc_id", "pos"]).withColumn("id", F.col("doc_id") * 100_000 + F.col("pos"))
    long = dedup.signatures(numbered.where("length(text) >= 20"), "text")
    gone = dedup.near_duplicates(long.select("id", "signature"))
    assert gone.where("id > 6000000").count() > 10
    want = numbered.join(gone, "id", "left_anti")
    free = "length(text) >= 20"
    assert rows(spark.read.parquet(out).where(free), "doc_id", "pos") == rows(want.where(free), "doc_id", "pos")
    assert registry.runs_before(spark, folder, 3) == [(0, 2), (1, 1)]
    runs = registry.runs_before(spark, folder, 4)
    assert runs == [(2, 3)] == registry.runs_before(spark, folder, 9)
    held = registry.bands(spark, folder, runs)
    kept = long.join(gone, "id", "left_anti").select("id", "signature")
    assert held.count() == dedup.band_buckets(kept).count()
    bucket = held.first()["bucket"]
    plan = held.where(F.col("slice").isin([bucket % registry.SLICES]) & (F.col("bucket") == bucket))
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters"):]
    assert "slice" in filters[: filters.index("]")] and "bucket" in text[text.index("PushedFilters") :]
    assert rows(registry.related(spark, folder, runs, spark.createDataFrame([(bucket,)], "bucket BIGINT")), "id") == rows(
        held.where(F.col("bucket") == bucket).select("id").distinct()
    )
    assert registry.runs_before(spark, folder, 0) == [] and registry.related(spark, folder, [], held).isEmpty()


def test_memory_stream_equals_batch(spark, tmp_path):
    schema = "conversation_id BIGINT, turn BIGINT, query STRING, answer STRING"
    data = [(c, t, f"q{c}{t}" * 60, None if t % 3 == 0 else f"a{c}{t}") for t in range(6) for c in range(4)]
    folder = str(tmp_path / "in")
    for turns in (range(0, 2), range(2, 6)):
        spark.createDataFrame([d for d in data if d[1] in turns], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (
        stream_memory.memory_stream(stream).writeStream.format("memory").queryName("memory_out")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run(q)
    out = spark.table("memory_out")
    assert out.count() == len(data)
    last = out.where("turn = 5")
    batch = spark.createDataFrame(data, schema).withColumn("sequence_id", F.col("turn") + 1)
    assert rows(last, "conversation_id", "stm") == rows(memory.short_term(batch))
    assert rows(last, "conversation_id", "memory") == rows(memory.memory_tail(batch))
    assert rows(last, "conversation_id", F.col("sequence_id") + 1) == rows(memory.next_sequence(batch))


def _numbered(data, schema, spark):
    w = W.partitionBy("conversation_id").orderBy("turn")
    return spark.createDataFrame(data, schema).withColumn("sequence_id", F.row_number().over(w).cast("bigint"))


def test_memory_stream_hot_conversation_in_frames(spark, tmp_path):
    schema = "conversation_id BIGINT, turn BIGINT, query STRING, answer STRING"
    data = [(1, t, f"q{t}", f"a{t}") for t in range(700)] + [(2, t, f"p{t}", None) for t in range(3)]
    random.Random(4).shuffle(data)
    folder = str(tmp_path / "in")
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(folder)
    limits = [f"spark.sql.execution.arrow.{x}maxRecordsPerBatch" for x in ("", "transformWithStateInPandas.")]
    before = {x: spark.conf.get(x, None) for x in limits}
    for x in limits:
        spark.conf.set(x, 100)
    try:
        stream = spark.readStream.schema(schema).parquet(folder)
        run(
            stream_memory.memory_stream(stream).writeStream.format("memory").queryName("hot_out")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
    finally:
        for x, value in before.items():
            spark.conf.unset(x) if value is None else spark.conf.set(x, value)
    out, batch = spark.table("hot_out"), _numbered(data, schema, spark)
    assert rows(out, "conversation_id", "turn", "sequence_id") == rows(batch, "conversation_id", "turn", "sequence_id")
    last = out.where("turn = CASE conversation_id WHEN 1 THEN 699 ELSE 2 END")
    assert rows(last, "conversation_id", "stm") == rows(memory.short_term(batch))
    assert rows(last, "conversation_id", "memory") == rows(memory.memory_tail(batch))


def test_memory_stream_puts_late_turns_in_order(spark, tmp_path):
    schema = "conversation_id BIGINT, turn BIGINT, query STRING, answer STRING, said_at TIMESTAMP"
    begin = datetime.datetime(2024, 5, 1, 12)
    at = lambda minutes: begin + datetime.timedelta(minutes=minutes)
    data = [(c, t, f"q{c}{t}", f"a{c}{t}", at(t)) for t in range(8) for c in range(3)]
    parts = [
        [d for d in data if d[1] in (0, 3, 5)],
        [d for d in data if d[1] in (1, 2)] + data[:2],  # late, and two turns sent again
        [d for d in data if d[1] in (4, 6, 7)] + [(9, 0, "no time", None, None)],
        [(100, 0, "later", "x", at(60))],
        [(100, 1, "much later", "y", at(600))],
        [(0, 50, "anew", "z", at(601)), (100, 2, "last", "z", at(2000))],
        [(100, 3, "end", "z", at(3000))],
    ]
    folder = str(tmp_path / "in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/part=*")
        run(
            stream_memory.memory_stream(stream, event_time="said_at", idle_ms=3_600_000).writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
    out, batch = spark.read.parquet(str(tmp_path / "out")), _numbered(data, schema, spark)
    first = out.where("conversation_id < 3 AND turn < 50")
    assert rows(first, "conversation_id", "turn", "sequence_id") == rows(batch, "conversation_id", "turn", "sequence_id")
    assert rows(first.where("turn = 7"), "conversation_id", "stm") == rows(memory.short_term(batch))
    assert rows(first.where("turn = 7"), "conversation_id", "memory") == rows(memory.memory_tail(batch))
    # After ten idle hours the conversation begins anew.
    assert rows(out.where("turn = 50"), "sequence_id", "stm") == [(1, "User: anew\nAssistant: z")]
    assert out.where("conversation_id = 9").isEmpty()
