import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import chunking, scan


def spans(text):
    return [(a, b) for a, b, _, _ in chunking.chunk_spans(text.encode())]


def test_chunks_of_plain_and_broken_text():
    assert spans("a" * 1200) == [(0, 512), (256, 768), (512, 1024), (768, 1200)]
    assert spans("a" * 500 + "\n" + "b" * 200 + "\n" + "c" * 200) == [(0, 501), (245, 702), (501, 902)]
    assert chunking.chunk_spans(b"one\ntwo\n") == [(0, 8, 1, 3)]
    assert spans("") == []


def test_chunks_end_at_whole_characters():
    data = ("é" * 400).encode()
    found = chunking.chunk_spans(data)
    assert len(found) >= 2
    for a, b, _, _ in found:
        data[a:b].decode()
    assert found[0][0] == 0 and found[-1][1] == len(data)


def test_windows():
    assert chunking.fixed_spans(0) == [] and chunking.fixed_spans(384) == [(0, 384)]
    assert chunking.fixed_spans(385) == [(0, 384), (192, 385)]
    assert chunking.fixed_spans(577) == [(0, 384), (192, 576), (384, 577)]
    assert chunking.prose_spans(b"ab\n\n\n\ncd") == [(0, 2), (6, 8)]
    assert chunking.code_spans(b"x" * 10 + b"\n\n" + b"y" * 200 + b"\n\n" + b"z" * 1500) == [(0, 212), (214, 1238), (726, 1714)]


def test_fixed_windows_agree_with_their_columns(spark):
    rows = spark.range(0, 1200).select(F.col("id"), chunking.fixed_windows(F.col("id")).alias("w")).collect()
    for r in rows:
        assert [(x["start"], x["end"]) for x in r["w"]] == chunking.fixed_spans(r["id"])


@pytest.mark.parametrize(("path", "kind"), [("src/lib.rs", "Code"), ("README.md", "Prose"), ("Cargo.toml", "Config"), ("app.LOG", "Log"), ("weird.xyz", "Unknown"), ("noext", "Unknown"), ("a.rs/b", "Unknown")])
def test_content_type(spark, path, kind):
    assert spark.range(1).select(tx.content_type(F.lit(path))).first()[0] == kind


def test_scan_finds_lines(texts):
    docs = texts(("a.txt", "one\nTODO two TODO\nthree"), ("b.txt", "none"), ("c.txt", "é TODO\r\nx"))
    rows = scan.scan_substring(docs, "TODO").orderBy("wal_entry_id").collect()
    assert [(r["wal_entry_id"], r["line_number"], r["byte_start"], r["byte_end"], r["snippet"], r["score"]) for r in rows] == [(0, 2, 4, 17, "TODO two TODO", 1.0), (2, 1, 0, 8, "é TODO", 1.0)]
    assert scan.scan_substring(docs, "").count() == 0 and scan.scan_substring(docs, "absent").count() == 0
    assert [r["line_number"] for r in scan.scan_substring(docs, "TODO\nthree").collect()] == [2]


def test_scan_regex_by_line_and_by_entry(texts):
    docs = texts(("a.txt", "x\nTODO one\nFIXME"), ("b.txt", "TODO"))
    assert scan.scan_regex(docs, "TODO|FIXME").count() == 3
    assert [r["wal_entry_id"] for r in scan.scan_regex(docs, "^TODO").collect()] == [1]


def test_scan_words_when_no_line_has_all(texts):
    docs = texts(("a.txt", "alpha\nbeta gamma"), ("b.txt", "alpha beta"))
    assert [(r["wal_entry_id"], r["score"]) for r in scan.scan_query(docs, "alpha beta").collect()] == [(1, 1.0)]
    rows = scan.scan_query(docs, "beta gamma gamma").orderBy("wal_entry_id").collect()
    assert [(r["wal_entry_id"], r["line_number"], r["score"]) for r in rows] == [(0, 2, 3.0), (1, 1, 1.0)]


def test_hits_belong_to_their_first_chunk(texts):
    docs = texts(("a.txt", "x" * 300 + " needle " + "y" * 900),)
    hits = scan.scan_substring(docs, "needle")
    row = scan.hit_chunks(hits, chunking.chunks(docs)).first()
    assert (row["chunk_id"], row["chunk_start"]) == (0, 0)
    alone = scan.hit_chunks(hits, chunking.chunks(docs.limit(0))).first()
    assert (alone["chunk_id"], alone["chunk_start"], alone["chunk_end"]) == (0, row["byte_start"], row["byte_end"])


def test_identifiers(spark):
    row = spark.range(1).select(tx.subtokens(F.lit("myVar_name-x:HTTPServer")), tx.subtoken_text(F.lit("(fooBar) std::fs")), tx.ident_tokens(F.lit("a.B c/d! e"))).first()
    assert row[0] == ["my", "var", "name", "x", "httpserver"]
    assert row[1] == ["foobar", "foo", "bar", "std::fs", "std", "fs"]
    assert row[2] == ["a.b", "c/d", "e"]
