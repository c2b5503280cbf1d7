import math

import pytest
from pyspark.sql import functions as F

from gleaner.operators import catalog, dense, evaluate, fusion, lexical, semantic
from gleaner.plans import compile as qc
from gleaner.plans.lexicon import document_share
from gleaner.plans.search import Index, SearchOptions
from gleaner.sources.entries import code_examples, directory, ignores, next_ids, recover_metadata


class Encoder:
    def __init__(self, weights):
        self.names = list(weights)
        self.weights = weights

    def encode(self, text):
        return [(k, self.weights[n]) for k, n in enumerate(self.names)]

    def piece(self, k):
        return self.names[k]


def test_normalize_and_tokenize():
    assert qc.normalize_query("  Extracts the ID.\nMore\n\nArgs:\n x") == "extracts the id."
    assert qc.normalize_query("Args:\n x") == "args: x"
    assert [t.text for t in qc.tokenize("how to the retry, error handling a error", "Prose")] == ["how", "retry", "error", "handling"]
    code = qc.tokenize("use std::fs error_handler C++ 429", "Code")
    assert [t.text for t in code] == ["use", "std::fs", "fs", "std", "error_handler", "error", "handler", "cpp", "429"]
    assert [t.kind for t in code if t.text in ("std::fs", "cpp", "429", "error_handler")] == ["Namespace", "Compound", "Language", "Numeric"]


def test_planner():
    assert qc.plan_query("/a|b/") == ("Regex", "a|b") and qc.plan_query('"x y"') == ("Exact", "x y")
    assert qc.plan_query("/")[0] == "Lexical" and qc.plan_query('""') == ("Exact", "")
    assert qc.plan_query("retry", qc.compile_query("retry"))[0] == "Semantic"


def test_compile_with_an_encoder():
    q = qc.compile_query("error handling", Encoder({"error": 2.0, "err": 1.2, "exception": 1.0, "##ing": 1.9, "rare": 0.1, "[CLS]": 3.0}), "Prose")
    found = {t.canonical: t for t in q.terms}
    assert found["error"].anchor and found["handling"].source == "OriginalToken"
    assert found["err"].source == "AliasExpansion" and found["err"].group_id == 0
    assert "rare" not in found and "[cls]" not in found
    assert q.phrases[0].canonical == "error handling"
    assert len(qc.compile_query("error", None).terms) == 1
    assert qc.compile_query("", None).terms == []
    again = [qc.compile_query("error handling", Encoder({"error": 2.0, "xyz": 1.9}), random_expansion=True).terms[-1].weight for _ in range(2)]
    assert again[0] == again[1]


def test_phrase_variants_and_fragments():
    q = qc.compile_query("failure handling", None)
    texts = {p.text for p in qc.realize(q)}
    assert {"failure_handling", "FAILURE_HANDLING", "failure-handling", "failureHandling", "FailureHandling"} <= texts
    term = qc.Term(0, "##ing", "ing", 1.0, 1.0, 0, True, "SparseExpansion")
    assert qc.term_variants(term, "Prose", {"retry"}, set()) == []


def test_common_patterns_go_unless_anchors():
    pattern = lambda text, anchor: qc.Pattern(0, text, 1.0, anchor, "Word", 0, 0, None)
    assert [p.text for p in qc.without_common([pattern("that", False), pattern("the", True)])] == ["the"]
    with pytest.raises(ValueError):
        qc.without_common([pattern("that", False)])
    assert document_share("the") > 0.3 and document_share("12345") == 0.0015 and 0.0015 <= document_share("retry_handler") <= 0.2


@pytest.mark.parametrize(("text", "mode", "hits"), [(b"handleErrorGracefully", "CodeSubtoken", 1), (b"my_Error_x", "CodeSubtoken", 1), (b"std::Error", "CodeSubtoken", 1), (b"tErrorism", "CodeSubtoken", 0), (b"tErrorism", "None", 1), (b"an Error!", "Word", 1), (b"an_Error", "Identifier", 0), (b"an_Error", "Word", 1)])
def test_boundaries(text, mode, hits):
    scanner = semantic.Scanner([qc.Pattern(0, "Error", 1.0, True, mode, 0, 0, None)])
    assert len(scanner.events(text)) == hits


def test_overlapping_events_are_all_found():
    scanner = semantic.Scanner([qc.Pattern(0, "aa", 1.0, True, "None", 0, 0, None)])
    assert [e[0] for e in scanner.events("éaaaa".encode())] == [2, 3, 4]


def test_idf_and_window_score():
    assert semantic.blended_idf(1, 2, 0.001) == pytest.approx(0.582477, abs=1e-6)
    e = lambda a, b, t: (a, b, t, None, t, 1.0 if t == 0 else 0.9, True)
    score = lambda events, n=64: semantic.score_window(events, n, {0: 1.0, 1: 0.9}, [0, 1], {0: 1.0, 1: 1.0}, 1.9)
    assert score([e(0, 7, 0)]) == pytest.approx(0.766782, abs=1e-5)
    assert score([e(0, 7, 0), e(8, 16, 1)]) == pytest.approx(2.025463, abs=1e-5)
    assert score([e(0, 7, 0), e(40, 48, 1)]) == pytest.approx(1.830875, abs=1e-5)
    assert score([e(0, 7, 0), e(300, 308, 1)], 512) == pytest.approx(1.174951, abs=1e-5)
    assert semantic.score_window([(0, 3, 0, None, 0, 1.0, False)], 64, {0: 1.0}, [0], {}, 1.0) == 0.0


def test_windows_need_an_anchor_and_hits_count(texts):
    docs = texts(("a", "error"), ("b", "error " * 5), ("c", "nothing")).withColumn("content_type", F.lit("Unknown"))
    q = qc.compile_query("error", None)
    rows = semantic.top_windows(semantic.window_scores(docs, q, qc.realize(q), document_share)).collect()
    assert [r["wal_entry_id"] for r in rows] == [1, 0]
    quick = semantic.window_scores(docs, q, qc.realize(q), document_share, no_window_scoring=True).orderBy("wal_entry_id").collect()
    assert [(r["score"], r["window_start"], r["window_end"]) for r in quick] == [(1.0, 0, 5), (5.0, 0, 29)]


def test_rerank_features():
    q = qc.compile_query("alpha beta", None)
    found = [(10, 15, 0, None, 0, 1.0, True), (20, 24, 1, None, 1, 1.0, True), (30, 35, 0, None, 0, 1.0, True)]
    rows, mask, window = semantic.rerank_features(found, (0, 100), q, {}, 0.5)
    assert len(rows) == 16 and sum(mask) == 3 and rows[2][10] == 1.0 and rows[1][2] == pytest.approx(0.05)
    assert window[0] == 0.5 and window[1] == 1.0 and window[8] == 3 / 16


def layer(spark, name, order, ids, scores=None, weight=None, coverage="Complete", frac=1.0, spans=None):
    rows = [(name, order, weight if weight is not None else fusion.WEIGHTS[name], coverage, frac, i, *(spans[k] if spans else (0, 10)), f"p{i}", 1, 1, 0, "s" * (k + 1), scores[k] if scores else 10.0 - k) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "layer string, layer_ord int, weight double, coverage string, frac double, wal_entry_id bigint, byte_start bigint, byte_end bigint, source_path string, line_start int, line_end int, chunk_id int, snippet string, score double")


def test_fused_scores(spark):
    one = fusion.coverage_fuse(layer(spark, "scan", 0, [1])).first()
    assert one["score"] == pytest.approx(0.128571, abs=1e-6) and one["layer"] == "fused"
    two = fusion.coverage_fuse(fusion.union([layer(spark, "scan", 0, [1]), layer(spark, "bm25", 1, [1])])).first()
    assert two["score"] == pytest.approx(0.122143, abs=1e-6)
    mixed = fusion.finalize(fusion.coverage_fuse(fusion.union([layer(spark, "scan", 0, [1, 2]), layer(spark, "bm25", 1, [2, 3])]))).collect()
    assert mixed[0]["wal_entry_id"] == 2 and {r["wal_entry_id"] for r in mixed} == {1, 2, 3}


def test_overlapping_ranges_merge_within_an_entry(spark):
    made = fusion.union([layer(spark, "scan", 0, [1], [1.0], spans=[(100, 220)]), layer(spark, "bm25", 1, [1], [1.0], spans=[(120, 240)]).withColumn("snippet", F.lit("longer"))])
    rows = fusion.coverage_fuse(made).collect()
    assert [(r["byte_start"], r["byte_end"], r["snippet"]) for r in rows] == [(120, 240, "longer")]
    apart = fusion.union([layer(spark, "scan", 0, [1], [1.0], spans=[(0, 10)]), layer(spark, "bm25", 1, [1], [1.0], spans=[(8, 30)])])
    assert fusion.coverage_fuse(apart).count() == 2
    far = fusion.coverage_fuse(fusion.union([layer(spark, "scan", 0, [9], coverage="Unavailable"), layer(spark, "bm25", 1, [1])])).collect()
    assert [r["wal_entry_id"] for r in far] == [1]
    part = fusion.with_ranks(layer(spark, "scan", 0, [1, 2], weight=1.0, coverage="Partial", frac=0.3)).first()
    assert part["layer_weight"] == pytest.approx(0.3)
    assert fusion.coverage_fuse(layer(spark, "scan", 0, [1]).limit(0)).count() == 0


def test_stale_rows_go_where_fresh_ones_are(spark):
    fresh = spark.createDataFrame([(100,)], "wal_entry_id bigint")
    both = fusion.union([layer(spark, "scan", 0, [100]), layer(spark, "bm25", 1, [200])])
    assert [r["wal_entry_id"] for r in fusion.stale_only_filter(both, fresh).collect()] == [100]
    assert fusion.stale_only_filter(layer(spark, "bm25", 0, [200, 300]), fresh).count() == 2


def test_dense(spark):
    unit = [[1.0 if k == j else 0.0 for k in range(8)] for j in range(8)]
    rows = spark.createDataFrame([(j, f"f{j}", v) for j, v in enumerate(unit)], "wal_entry_id bigint, source_path string, embedding array<float>")
    assert dense.knn(rows, unit[5], 3, ("source_path",)).first()["wal_entry_id"] == 5
    with pytest.raises(Exception, match="vector of length"):
        dense.knn(rows, [1.0], 1, ("source_path",)).collect()
    scored = spark.createDataFrame([("A", 0.95, 0), ("A", 0.94, 1), ("B", 0.93, 2)], "source_path string, score double, rank int")
    assert {(r["source_path"], r["score"]) for r in dense.collapse_by_file(scored).collect()} == {("A", 0.95), ("B", 0.93)}
    results = spark.createDataFrame([(10, 0.6382), (11, 0.6288)], "wal_entry_id bigint, score double")
    best = dense.recency_bonus(results, results).orderBy(F.desc("score")).collect()
    assert [r["wal_entry_id"] for r in best] == [11, 10] and best[0]["score"] == pytest.approx(0.6488) and best[1]["score"] == pytest.approx(0.6482)


def test_promotion(spark):
    chunks = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "wal_entry_id bigint, chunk_id int")
    ids = chunks.select("wal_entry_id")
    hits = spark.createDataFrame([(1, 1)], "wal_entry_id bigint, rank int")
    none = ids.limit(0)
    assert [r["wal_entry_id"] for r in dense.promoted(chunks, none, hits, ids, limit=2).collect()] == [1, 3]
    assert dense.promoted(chunks, ids, hits, ids).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "episode int, path string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "d")], "episode int, path string")
    row = evaluate.recall_hit_mrr(hits, relevant, 5).first()
    assert (row["recall"], row["hit"], row["mrr"]) == (0.5, True, 0.5)
    assert spark.range(1).select(evaluate.retention(F.lit(0.4), F.lit(0.6))).first()[0] == pytest.approx(2 / 3)
    late = spark.createDataFrame([(10.0, 5), (10.0, 0), (10.0, None)], "latency_ms double, deadline_ms int")
    assert evaluate.within_deadline(late).count() == 2
    assert spark.range(1).select(evaluate.lower_percentile(F.array(*map(F.lit, [4, 1, 3, 2])), 50)).first()[0] == 2


def test_bm25_against_its_formula(texts):
    docs = texts(("a", "cat dog dog"), ("b", "dog"), ("c", "bird bird bird bird"))
    rows = {r["source_path"]: r["score"] for r in lexical.search_lexical(docs, "dog", 10)[0].collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert rows["a"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (8 / 3))))
    assert set(rows) == {"a", "b"}
    assert lexical.parse_query("foo::bar") == ("ident", ["foo::bar"]) and lexical.parse_query("(x")[0] == "bad"


def test_catalog(spark):
    m = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "source_path string, wal_entry_id bigint")
    latest = catalog.latest_per_path(m)
    assert {tuple(r) for r in latest.collect()} == {("a", 3), ("b", 2)}
    indexed, fresh = catalog.snapshot(latest.select("wal_entry_id"), spark.createDataFrame([(2,), (1,)], "wal_entry_id bigint"))
    assert [r[0] for r in indexed.collect()] == [2] and [r[0] for r in fresh.collect()] == [3]
    tie = spark.createDataFrame([("a.rs",), ("b.md",)], "source_path string")
    assert catalog.dominant_content_type(tie).first()["content_type"] == "Prose"
    ids = next_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "source_path string"), 4)
    assert sorted(r["wal_entry_id"] for r in ids.collect()) == [5, 6, 7] and {r["source_path"] for r in ids.collect()} == {"a", "b", "c"}
    again = next_ids(ids.select("source_path").repartition(3), 4)
    assert {tuple(sorted(r.asDict().items())) for r in ids.collect()} == {tuple(sorted(r.asDict().items())) for r in again.collect()}


def test_recovery_and_sources(spark, tmp_path):
    good = '{"wal_entry_id": 0, "source_path": "a", "content_hash": "", "byte_offset": 0, "byte_length": 5, "committed_at": 1}'
    lines = spark.createDataFrame([(good,), (good[:40],), (good.replace('"byte_length": 5', '"byte_length": 50'),), ("\x00",)], "value string")
    assert [(r["wal_entry_id"], r["line_range_start"]) for r in recover_metadata(lines, 10).collect()] == [(0, 1)]
    (tmp_path / ".git").mkdir()
    for name, text in (("a.txt", b"x\xff"), (".hidden", b"h"), ("skip.log", b"l"), (".git/x", b"g"), (".gitignore", b"*.log\n")):
        (tmp_path / name).write_bytes(text)
    found = {r["source_path"]: r["content"] for r in directory(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.txt", ".hidden", ".gitignore"} and found["a.txt"] == "x�"
    assert ignores(["build/", "!build/keep"], "build/x") and not ignores(["/a"], "b/a") and ignores(["a"], "b/a")
    (tmp_path / "c.jsonl").write_text('{"code": "x", "docstring": "d"}\n{"code": " ", "docstring": "d"}\n')
    assert code_examples(spark, str(tmp_path / "c.jsonl")).count() == 1


def test_index_from_append_to_search(spark, tmp_path):
    index = Index.open_or_create(spark, str(tmp_path / "index"), embed=lambda t: [float(len(t)), 1.0])
    assert index.search("needle").count() == 0
    first = index.add_text("a.txt", "a needle here\nand hay")
    assert index.search("needle").first()["wal_entry_id"] == first
    assert index.build_pending_shards() == 1 and index.build_pending_shards() == 0
    index.add_text("b.txt", "more needle")
    indexed, fresh = index.snapshot()
    assert indexed.count() == 1 and fresh.count() == 1
    index.add_text("a.txt", "replaced")
    assert [r["source_path"] for r in index.search('"needle"').collect()] == ["b.txt"]
    assert index.search_with_outcome("/need.e/").plan == "regex"
    assert index.read_entry_content(first) == "a needle here\nand hay"
    with pytest.raises(KeyError):
        index.read_entry_content(99)
    assert index.embed_pending() == 3 and index.embed_pending() == 0
    assert index.search("needle", SearchOptions(fresh_only=True)).count() >= 1
    row = index.status().first()
    assert (row["entries"], row["active"], row["embedded"], row["delta"]) == (3, 2, 3, 0)
    assert index.export_training(["needle hay"], str(tmp_path / "train")) == 1 and spark.read.json(str(tmp_path / "train")).count() >= 1


def test_index_with_an_encoder(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), encoder=Encoder({"retry": 2.0, "again": 1.2}))
    index.add_text("a.py", "def retry(): pass")
    index.build_pending_shards()
    index.add_text("b.py", "retry again")
    out = index.search_with_outcome("retry")
    assert out.plan == "semantic" and [r["source_path"] for r in out.results.collect()] == ["b.py"]
    assert index.search_semantic_query(index.compile("retry", SearchOptions())).count() == 2
    files = spark.createDataFrame([("a.py", "new", None, 3)], "source_path string, content string, mtime timestamp, size bigint")
    assert index.index_files(files) == 1 and [r["source_path"] for r in index.manifest().collect()] == ["a.py"]


def test_command_line(spark, tmp_path, monkeypatch):
    import io
    import json

    from gleaner import cli

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("one\nneedle two\nthree")
    (tmp_path / "files" / "b.md").write_text("other")

    def run(*argv):
        out = io.StringIO()
        assert cli.main([*argv, "--index", str(tmp_path / "i")], out) == 0
        return out.getvalue().strip()

    assert run("index", str(tmp_path / "files")) == "2 files added"
    assert run("index", str(tmp_path / "files")) == "0 files added"
    found = json.loads(run("search", "needle", "--format", "json"))
    assert sorted((r["path"], r["line"], r["layer"], r["byte_range"]) for r in found) == [("a.md", 2, "fused", [0, 20]), ("a.md", 2, "fused", [4, 14])]
    assert run("search", "needle", "--context", "1").endswith(":one\\nneedle two\\nthree")
    (tmp_path / "files" / "a.md").unlink()
    assert run("index", str(tmp_path / "files")) == "0 files added" and run("search", "needle") == ""
    assert json.loads(run("status"))["active"] == 1
    assert run("export-training", str(tmp_path / "t"), "other") == "1 queries exported"


def test_models_and_reranking(texts):
    from gleaner.plans.models import Models, reranked

    encoder = Encoder({"retry": 2.0})
    models = Models(sparse={"generic": encoder})
    assert models.route("Code") is encoder and models.present() == {"sparse": ["generic"], "dense": [], "rerank": []} and Models().route("Prose") is None
    docs = texts(*[(f"f{k:02d}", "alpha " * (k + 1) + "beta") for k in range(12)]).withColumn("content_type", F.lit("Unknown"))
    q = qc.compile_query("alpha beta", None)
    rows = reranked(docs, q, qc.realize(q), document_share, lambda e, m, w: -w[8]).collect()
    assert len(rows) == 12 and rows[0]["source_path"] == "f00"
    assert reranked(docs, q, qc.realize(q), document_share, lambda e, m, w: 0.0, least=12).count() == 0
    one = qc.compile_query("alpha", None)
    assert reranked(docs, one, qc.realize(one), document_share, lambda e, m, w: 0.0).count() == 0


def test_deadlines(spark, tmp_path):
    from gleaner.plans.harness import Episode, IndexRunner, run_episode

    class Slow:
        name = "slow"

        def prepare(self, stable):
            self.paths = [p for p, _ in stable]

        def arrive(self, fresh):
            self.late = [p for p, _ in fresh]

        def settle(self):
            self.paths += self.late

        def search(self, query, k):
            import time

            time.sleep(0.03)
            return self.paths[:k]

    episode = Episode("e", [("a", "x")], [("b", "needle")], "needle", {"b"})
    rows = run_episode(spark, Slow(), episode, deadlines=(0, 5, 500, None)).collect()
    assert [(r["deadline_ms"], r["path"], r["rank"], r["relevant"]) for r in rows] == [(0, "a", 1, False), (500, "a", 1, False), (None, "a", 1, False), (None, "b", 2, True)]
    found = run_episode(spark, IndexRunner(spark, str(tmp_path / "i")), episode, deadlines=(0, None)).collect()
    assert [(r["deadline_ms"], r["path"]) for r in found] == [(0, "b"), (None, "b")]


def test_compaction_keeps_what_is_found(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    for k in range(3):
        index.add_text(f"f{k}.txt", f"text number{k}")
        index.build_pending_shards()
    before = index.chunk_count()
    index.compact(1)
    assert index.chunk_count() == before == 3 and index.search("number2").first()["source_path"] == "f2.txt"
    assert index.wal_entries_count() == 3 and not index.should_skip_source("f0.txt", None, 3) and not index.delta_fallback_over_budget() and index.delta_fallback_over_budget(2)


def test_layers_are_fused_whole(spark):
    n = 1500
    rows = spark.range(n).select(F.col("id").alias("wal_entry_id"), F.lit(0).cast("long").alias("byte_start"), F.lit(9).cast("long").alias("byte_end"), F.format_string("p%05d", "id").alias("source_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit(0).alias("chunk_id"), F.lit("of the").alias("snippet"), F.lit(1.0).alias("score"))
    both = fusion.union([fusion.layer(rows, "scan", 0), fusion.layer(rows.withColumn("score", F.col("wal_entry_id") % 7 + 1.0), "bm25", 1)]).repartition(5)
    got = {(r["layer_ord"], r["wal_entry_id"]): r["rank"] for r in fusion.with_ranks(both).collect()}
    assert got == {**{(0, i): i for i in range(n)}, **{(1, i): k for k, i in enumerate(sorted(range(n), key=lambda i: (-(i % 7), i)))}}
    assert fusion.coverage_fuse(both).count() == n
    fresh = spark.createDataFrame([(n - 1,)], "wal_entry_id bigint")
    assert {(r["layer"], r["wal_entry_id"]) for r in fusion.stale_only_filter(both, fresh).collect()} == {("scan", n - 1), ("bm25", n - 1)}


def test_an_entry_without_vectors_is_found_by_meaning(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), embed=lambda t: [float("feline" in t or "cat" in t), 0.1])
    index.add_text("a.txt", "about dogs")
    index.embed_pending()
    index.add_text("b.txt", "a cat")
    out = index.search_with_outcome("feline animals")
    assert out.layers[-3:] == ["vec", "promoted", "delta"]
    assert out.results.first()["source_path"] == "b.txt"
    assert "delta" not in index.search_with_outcome("feline animals", SearchOptions(allow_delta_fallback=False)).layers


def test_slices_hold_every_row_within_the_bound():
    import pyarrow as pa

    from gleaner.storage import slices

    texts = ["ab", None, "c" * 50, "", "déf", "g" * 9] * 20
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(texts))), pa.array(texts)], names=["id", "text"]) for k in (0, 1000)]
    made = list(slices(iter(batches), 1, 16))
    assert [r for b in made for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 16 for b in made)
    assert not list(slices(iter([batches[0].slice(0, 0)]), 1))


def test_what_a_scan_makes_of_a_batch_is_bounded(spark, texts, monkeypatch):
    """A worker of a scan, of postings and of chunks hands on the rows of a slice, not of a whole batch."""
    import pyarrow as pa
    from pyspark.sql import DataFrame

    from gleaner.operators import chunking, lexical

    sizes, batch = [], pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["p"] * 40), pa.array(["word " * 20_000] * 40)], names=["wal_entry_id", "source_path", "content"])
    run = lambda self, f, schema: sizes.append([b.num_rows for b in f(iter([batch]))]) or self
    monkeypatch.setattr(DataFrame, "mapInArrow", run)
    monkeypatch.setattr(type(texts(("p", "c"))), "mapInArrow", run)
    monkeypatch.setattr(lexical, "written", lambda df, label: df)
    docs = texts(("p", "c"))
    chunking.chunks(docs)
    lexical.postings(docs, keys=("wal_entry_id", "source_path"))
    lexical.chunk_counts(docs, ["word"], "word")
    assert len(sizes) == 3 and all(len(s) == 4 for s in sizes)


def test_postings_of_some_terms_are_those_of_all(spark, texts):
    from gleaner.operators import chunking, lexical

    docs = texts(("a", "parseHTTP the_Fast ünïcode the 12-x\n" * 40), ("b", None), ("c", ""), ("d", "the end of a::b/c.d"))
    made, keys = chunking.chunks(docs), ("wal_entry_id", "chunk_id")
    wanted = {"body": {"the", "none"}, "ident": {"the_fast"}, "subtoken": {"fast", "parse"}}
    table, stats = lexical.term_postings(docs, wanted)
    every = {f: lexical.postings(made, f, keys, "text").collect() for f in lexical.FIELDS}
    assert sorted(map(tuple, table.collect())) == sorted((*r[:2], r["field"], r["term"], r["tf"], r["doc_len"]) for f, rows in every.items() for r in rows if r["term"] in wanted[f])
    n = made.count()
    assert {r["field"]: (r["n_docs"], round(r["mean_len"], 9)) for r in stats.collect()} == {f: (n, round(sum(r["tf"] for r in rows) / n, 9)) for f, rows in every.items()}


def test_blocks_unpack_to_postings(spark, texts):
    from gleaner.operators import chunking, lexical

    made = chunking.chunks(texts(("a", "parseHTTP the_Fast ünïcode the 12-x\n" * 40), ("b", "the the"), ("c", "  ")))
    blocks = lexical.posting_blocks(made)
    got = sorted((r["field"], r["term"], r["wal_entry_id"], r["chunk_id"], r["tf"], r["doc_len"]) for r in lexical.unpacked(blocks).collect())
    assert got == sorted((f, r["term"], r["wal_entry_id"], r["chunk_id"], r["tf"], r["doc_len"]) for f in lexical.FIELDS for r in lexical.postings(made, f, ("wal_entry_id", "chunk_id"), "text").collect())
    assert all(r["tokens"] == sum(r["tfs"]) and r["bucket"] == lexical.term_bucket(r["term"]) for r in blocks.collect())
    assert blocks.count() < len(got)


def test_compaction_splits_what_is_over_a_files_size(spark, tmp_path, monkeypatch):
    from gleaner.plans import search

    index = search.Index(spark, str(tmp_path))
    index.add_rows(spark.createDataFrame([(f"f{k}.txt", f"alpha{k} beta " * 50) for k in range(20)], "source_path string, content string"))
    index.build_pending_shards()
    before = sorted(map(str, index.postings().collect()))
    monkeypatch.setattr(search, "FILE_BYTES", 500)
    index.compact(1)
    assert len(list(tmp_path.glob("chunks/v1/*.parquet"))) > 1
    assert sorted(map(str, index.postings().collect())) == before


def test_an_append_writes_and_shuffles_contents_once(spark, tmp_path):
    from gleaner.plans.search import Index

    index = Index(spark, str(tmp_path))
    rows = spark.createDataFrame([("a.txt", "one", None, 3), ("b.txt", "two", None, 9)], "source_path string, content string, mtime timestamp, size bigint")
    assert index.add_rows(rows).count() == 2 and index.add_rows(rows.where("source_path = 'a.txt'").drop("mtime", "size")).first()["wal_entry_id"] == 2
    assert {r["source_path"]: (r["wal_entry_id"], r["size"]) for r in index.manifest().collect()} == {"a.txt": (2, 3), "b.txt": (index.entries().where("source_path = 'b.txt'").first()["wal_entry_id"], 9)}
    assert not (tmp_path / "batches").exists()
