import hashlib
import random

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.test_dedup import brute_groups, brute_lines, edited, prose
from tests.llm.test_toxicity_curriculum import BAD

import corpus_pipeline
from gleaner.llm import curriculum, line_dedup, pieces, simhash, toxicity
from gleaner.llm.common import hold


def test_every_stage_against_plain_python(spark, tmp_path):
    """Planted toxic documents, shared passages and copies go; the clean rest comes out encoded, in order."""
    rng = random.Random(11)
    passage = " ".join(prose(rng, 60))
    rows, toxic, copies = [], set(), set()
    for i in range(240):
        words = prose(rng, rng.randint(60, 200))
        if i % 6 == 0:
            toxic.add(i)
            for k in range(max(4, len(words) // 15)):
                words[(k * 13) % len(words)] = rng.choice(BAD)
        text = " ".join(words)
        if i % 10 == 3:
            text = f"{text}\n{passage}"
        if i % 20 == 11:
            copies.add(i)
            text = " ".join(edited(rng, rows[i - 4][1].split("\n")[0].split(), 0.01))
        rows.append((i, text))
    made = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("train_part", "train_row").collect()

    left = [(i, t) for i, t in rows if i not in toxic]
    lines = brute_lines(left)
    left = [(i, lines[i]) for i, t in left if lines[i].strip()]
    assert sum(passage in t for _, t in left) == 1
    _, groups = brute_groups([(i, dict(rows)[i]) for i, _ in left])
    left = [(i, t) for i, t in left if groups[i] == i]
    assert not copies & {i for i, _ in left}
    encode = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: encode(t) for i, t in left}

    sources = {s: [(i, t) for i, t in left if i % 3 == s] for s in range(3)}
    supply = {f"src{s}": float(sum(len(t.split()) for _, t in x)) for s, x in sources.items()}
    schedule = curriculum.natural_schedule(supply, {f"src{s}": len(x) for s, x in sources.items()})
    for s in range(3):
        mine = [r["doc_id"] for r in got if r["source"] == f"src{s}"]
        assert mine == sorted(mine, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert sum(w for _, w in schedule[f"src{s}"]) / 2 * sum(supply.values()) - supply[f"src{s}"] < 1e-6


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.fieldNames() == docs.schema.fieldNames()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "text without id", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 100_000, "en", "s", 1)], schema)
    odd.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] is None) for r in got) == [(0, False), (1, True), (2, False), (2, False), (3, False)]


def test_texts_go_to_python_in_batches_bounded_by_bytes(spark):
    """10,000 texts of 2,000 letters, Spark's own bound, would be one batch of 20 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 2000).alias("text"))

    def sizes(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    makers = [simhash.fingerprints, line_dedup.line_postings, pieces.encode_pieces, pieces.with_round_trip, lambda d: toxicity.with_severity(d, toxicity.OrdinalModel())]
    before = spark.conf.get(name, None)
    try:
        for make in makers:
            spark.conf.unset(name)
            make(docs)
            got = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == 10_000 and max(r["size"] for r in got) < 3 << 20
        spark.conf.set(name, "5m")
        for make in makers:
            make(docs)
            assert spark.conf.get(name) == "5m"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_the_curriculum_needs_no_python_workers(spark):
    """A list of rows as a table is read by Python workers of its own, which stay for a minute."""
    table = spark.range(19).selectExpr("id doc_id", "concat('a b ', id) text", "concat('src', id % 3) source")
    plan = curriculum.mix(table, schedule=None)._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_a_worker_holds_the_words_of_one_operator():
    model, severe = pieces.PieceModel(), toxicity.OrdinalModel({"bad": 1.0}, [0.5])
    hold(model)
    ids = model.encode(["some words of a text"])[0].tolist()
    hold(model)
    assert len(model.code) == 5
    hold(severe.words())
    assert not model.code and not model.used
    assert severe.scores(["bad words"]).tolist() == [50.0] and len(severe.words()) == 2
    hold(None)
    assert not severe.words() and severe.scores(["bad words"]).tolist() == [50.0]
    assert model.encode(["some words of a text"])[0].tolist() == ids
