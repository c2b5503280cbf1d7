"""Lexical retrieval: postings, BM25, phrases and weighted boolean queries. A document is a chunk of an entry.

Statistics (number of chunks, mean length, document frequencies) are those of the whole table. Entries
without postings are read once: the pass counts the words of the chunks where they lie, in numpy over the entry's
letters, and writes a narrow row for each chunk that holds one of the query's; these give frequencies and scores. With
postings, those of the query's terms are read, which their files are laid out for.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import body_tokens, subtoken_text
from gleaner.operators.chunking import chunk_spans, chunks
from gleaner.storage import slices, small_batches, spread, written

K1, B = 1.2, 0.75
_IDENT = re.compile(r"[\w:./\\-]+", re.ASCII)


_WORD = re.compile(r"[^\W_]+")
_EDGES = re.compile(r"^[^A-Za-z0-9_:.]+|[^A-Za-z0-9_:.]+$")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_PARTS = re.compile(r"[_\-.:/\\]")
_TURN = re.compile(r"([a-z])([A-Z])")
FIELDS = ("body", "ident", "subtoken")
_KEPT = 64
#: Parts of the postings by a hash of the term; a query reads those of its terms.
BUCKETS = 64


def field_words(text: str, field: str) -> list[str]:
    """The tokens of a text in a field."""
    if field == "body":
        return _WORD.findall(text.lower())
    if field == "ident":
        return [t.lower() for t in _IDENT.findall(text)]
    return [p for w in _SPACE.split(text) for p in (_subtokens(w) if len(w) <= _KEPT else _subtokens.__wrapped__(w))]


@lru_cache(maxsize=1 << 15)
def _subtokens(word: str) -> tuple[str, ...]:
    """What a word between spaces gives, kept for recent words of up to ``_KEPT`` letters."""
    word = _EDGES.sub("", word)
    return (word.lower(), *[p for p in _PARTS.split(_TURN.sub(r"\1_\2", word).lower()) if p]) if word else ()


def postings(texts: DataFrame, field: str = "body", keys: tuple[str, ...] = ("wal_entry_id",), text: str = "content") -> DataFrame:
    """``(keys, field, term, tf, doc_len)``. A document's tokens are counted within its row, so nothing is shuffled."""
    small_batches(texts.sparkSession)
    rows = texts.select(*keys, text)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, len(keys)):
            at, terms, tf, size = [], [], [], []
            for k, content in enumerate(batch.column(len(keys)).to_pylist()):
                counts = Counter(field_words(content or "", field))
                at += [k] * len(counts)
                terms += counts.keys()
                tf += counts.values()
                size += [counts.total()] * len(counts)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(len(keys))], pa.array([field] * len(at), pa.string()), pa.array(terms, pa.string()), pa.array(tf, pa.int32()), pa.array(size, pa.int32())], names=[*keys, "field", "term", "tf", "doc_len"])

    return spread(rows).mapInArrow(batches, f"{kinds}, field string, term string, tf int, doc_len int")


_TERMS = "wal_entry_id bigint, chunk_id int, field string, term string, tf int, doc_len int, chunks bigint, tokens bigint"


def term_postings(entries: DataFrame, terms: dict[str, set[str]]) -> tuple[DataFrame, DataFrame]:
    """The postings of these terms, by field, in the chunks of ``(wal_entry_id, content)``, and the fields' statistics ``(field, n_docs, mean_len)``.

    One pass over the entries counts all tokens of all chunks where they lie. It writes a row for each chunk and term asked for, and for each slice
    and field one without a term that has the number of all chunks and of their tokens; the postings of other terms are never rows."""
    small_batches(entries.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _TERMS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in slices(it, 1):
            rows, n_chunks, tokens = [], 0, dict.fromkeys(terms, 0)
            for entry, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (content or "").encode()
                for k, (a, b, _, _) in enumerate(chunk_spans(data)):
                    n_chunks, text = n_chunks + 1, data[a:b].decode()
                    for field, wanted in terms.items():
                        found = field_words(text, field)
                        tokens[field] += len(found)
                        rows += [(entry, k, field, t, found.count(t), len(found), None, None) for t in wanted.intersection(found)]
            rows += [(None, None, field, None, None, None, n_chunks, n) for field, n in tokens.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = written(spread(entries.select("wal_entry_id", "content")).mapInArrow(batches, _TERMS), "term-postings")
    return found.where("term is not null").drop("chunks", "tokens"), field_stats(found.where("term is null").select("field", "chunks", "tokens"))


BLOCKS = "field string, term string, bucket int, entries array<bigint>, chunks array<int>, tfs array<smallint>, lens array<smallint>, tokens bigint"


def posting_blocks(made: DataFrame) -> DataFrame:
    """The postings of chunks ``(wal_entry_id, chunk_id, text)`` in all fields: of each slice of the chunks a row for each field and term, with the
    entries and chunks that hold it, how often they do, and their numbers of tokens, side by side. ``tokens``: the uses of the term
    in them all. One pass; ``unpacked`` gives a row for each chunk. A chunk has a few hundred bytes, so its counts fit 16 bits."""
    small_batches(made.sparkSession)

    def block(batch: pa.RecordBatch, field: str) -> pa.RecordBatch:
        words, sizes, n = [], [], max(batch.num_rows, 1)
        for text in batch.column(2).to_pylist():
            found = field_words(text or "", field)
            words += found
            sizes.append(len(found))
        coded = pa.array(words, pa.string()).dictionary_encode()
        sizes = np.array(sizes, np.int64)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        code, chunk = key // n, key % n
        first = np.flatnonzero(np.diff(code, prepend=-1))
        ends = pa.array(np.append(first, len(code)), pa.int32())
        lists = [batch.column(0).take(pa.array(chunk)), batch.column(1).take(pa.array(chunk)), pa.array(tf.astype(np.int16)), pa.array(sizes[chunk].astype(np.int16))]
        terms = coded.dictionary.take(pa.array(code[first]))
        tokens = np.add.reduceat(tf, first) if len(first) else tf
        columns = [pa.array([field] * len(first), pa.string()), terms, pa.array([term_bucket(t) for t in terms.to_pylist()], pa.int32()), *[pa.ListArray.from_arrays(ends, c) for c in lists], pa.array(tokens, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 2, 4 << 20):
            for field in FIELDS:
                yield block(batch, field)

    return spread(made.select("wal_entry_id", "chunk_id", "text")).mapInArrow(batches, BLOCKS)


def unpacked(blocks: DataFrame) -> DataFrame:
    """``(wal_entry_id, chunk_id, field, term, tf, doc_len, bucket)`` of blocks. Filters by field, term and bucket reach the blocks."""
    rows = blocks.select("field", "term", "bucket", F.explode(F.arrays_zip("entries", "chunks", "tfs", "lens")).alias("p"))
    return rows.select(F.col("p.entries").alias("wal_entry_id"), F.col("p.chunks").alias("chunk_id"), "field", "term", F.col("p.tfs").cast("int").alias("tf"), F.col("p.lens").cast("int").alias("doc_len"), "bucket")


def term_bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, doc_len: Column, mean_len: Column, n: Column, df: Column) -> Column:
    return idf(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean_len))


def query_terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter or a digit, and its small letter."""
    inside = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)
    small = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(inside).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            small[c] = ord(low)
    return inside, small


class _Words:
    """The words of an entry: where each starts and ends, in bytes, and where those asked for are."""

    def __init__(self, text: str, terms: list[str]) -> None:
        inside, small = _letters()
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        held = np.zeros(len(code) + 2, bool)
        held[1:-1] = inside[code]
        edges = np.flatnonzero(held[1:] != held[:-1])
        first, last = edges[::2], edges[1::2]
        self.places = []
        for t in terms:
            letters = np.array([ord(c) for c in t], np.uint32)
            at = np.flatnonzero(last - first == len(letters))
            for k, c in enumerate(letters):
                at = at[small[code[first[at] + k]] == c]
            self.places.append(at)
        if len(code) and code.max() >= 0x80:
            byte = np.concatenate([[0], np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))])
            first, last = byte[first], byte[last]
        self.first, self.last = first, last

    def counts(self, data: bytes, spans: list[tuple[int, int, int, int]], terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each chunk, and occurrences of each term. A word that a chunk's edge cuts is what the chunk has of it."""
        a, b = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        low, high = np.searchsorted(self.last, a, "right"), np.searchsorted(self.first, b, "left")
        tf = np.array([np.searchsorted(p, high) - np.searchsorted(p, low) for p in self.places]).reshape(len(terms), len(spans))
        some = high > low
        left = some & (self.first[np.minimum(low, len(self.first) - 1)] < a) if len(self.first) else some
        right = some & (self.last[np.maximum(high - 1, 0)] > b) if len(self.first) else some
        for k in np.flatnonzero(left | right).tolist():
            for word in {low[k]} if low[k] == high[k] - 1 else {w for w, cut in ((low[k], left[k]), (high[k] - 1, right[k])) if cut}:
                part = data[max(a[k], self.first[word]) : min(b[k], self.last[word])].decode().lower()
                for t, (term, places) in enumerate(zip(terms, self.places, strict=True)):
                    at = np.searchsorted(places, word)
                    tf[t, k] += (part == term) - int(at < len(places) and places[at] == word)
        return high - low, tf


_FOUND = "wal_entry_id bigint, source_path string, chunk_id int, byte_start bigint, byte_end bigint, line_start int, line_end int, snippet string, n int, tf array<int>, text string, chunks bigint, tokens bigint"


def _snippet(text: str, query: str) -> tuple[int, str]:
    """The first line with the whole query, else with any of its words, else the first; and its number from 0."""
    lines, whole = text.split("\n"), query.strip().strip('"')
    words = query.split()
    k = next((k for k, x in enumerate(lines) if whole and whole in x), None)
    if k is None:
        k = next((k for k, x in enumerate(lines) if any(w in x for w in words)), 0)
    return k, lines[k].removesuffix("\r")


def chunk_counts(entries: DataFrame, terms: list[str], query: str, with_text: bool = False) -> DataFrame:
    """One pass over ``(wal_entry_id, source_path, content)``: a row for each chunk that holds a term, with the number of its words
    and of each term's occurrences and the line to show; and for each slice of a batch a row without a chunk that has the number
    of all its chunks and of their words. Written, so that it is computed once."""
    small_batches(entries.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FOUND.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64()]
        for batch in slices(it, 2):
            rows, n_chunks, tokens = [], 0, 0
            for entry, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not content:
                    continue
                data = content.encode()
                spans = chunk_spans(data)
                n, tf = _Words(content, terms).counts(data, spans, terms)
                n_chunks, tokens = n_chunks + len(spans), tokens + int(n.sum())
                for k in np.flatnonzero(tf.any(axis=0)).tolist():
                    start, end, first, _ = spans[k]
                    text = data[start:end].decode()
                    line, shown = _snippet(text, query)
                    rows.append((entry, path, k, start, end, first + line, first + line, shown, int(n[k]), tf[:, k].tolist(), text if with_text else None, None, None))
            rows.append((*[None] * 11, n_chunks, tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return written(spread(entries.select("wal_entry_id", "source_path", "content")).mapInArrow(batches, _FOUND), "chunk-counts")


SHOWN = ["wal_entry_id", "source_path", "chunk_id", "byte_start", "byte_end", "line_start", "line_end", "snippet"]


def bm25_scan(entries: DataFrame, terms: list[str], query: str | None = None, anchors: list[str] | None = None, boosts: dict[str, float] | None = None, with_text: bool = False) -> DataFrame:
    """The chunks of the entries that hold a term (of ``anchors``, where given), with their place, the line to show for
    the query, and the score. Each term's score counts ``boosts`` times. No terms: no rows."""
    found = chunk_counts(entries, terms, query if query is not None else " ".join(terms), with_text)
    rows = found.where("chunk_id is not null")
    stats = found.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_docs"), (F.sum("tokens") / F.greatest(F.sum("chunks"), F.lit(1))).alias("mean_len"), *[F.coalesce(F.sum((F.col("tf")[k] > 0).cast("long")), F.lit(0)).alias(f"df{k}") for k in range(len(terms))])
    must = [k for k, w in enumerate(terms) if anchors is None or w in anchors]
    held = F.greatest(*[F.col("tf")[k] for k in must], F.lit(0), F.lit(0)) > 0
    score = sum((bm25(F.col("tf")[k].cast("double"), F.col("n"), F.col("mean_len"), F.col("n_docs"), F.col(f"df{k}")) * float((boosts or {}).get(w, 1.0)) for k, w in enumerate(terms)), F.lit(0.0))
    return rows.where(held).crossJoin(F.broadcast(stats)).select(*SHOWN, *["text"] * with_text, score.alias("score"))


def field_stats(table: DataFrame) -> DataFrame:
    """``(field, n_docs, mean_len)`` of a table of counters ``(field, chunks, tokens)``, a row for each field and append."""
    return table.groupBy("field").agg(F.sum("chunks").alias("n_docs"), (F.sum("tokens") / F.sum("chunks")).alias("mean_len"))


def bm25_postings(table: DataFrame, stats: DataFrame, clauses: DataFrame, keys: tuple[str, ...] = ("wal_entry_id", "chunk_id")) -> DataFrame:
    """``(keys, score)`` from postings and clauses ``(field, term, boost, kind)``: documents must
    match a clause of kind ``anchor``, and others add to the score. ``stats``: ``(field, n_docs, mean_len)``. Clauses are a
    compiled query, and frequencies have a row for each of its terms, so both are broadcast."""
    found = table.join(F.broadcast(clauses), ["field", "term"])
    df = table.join(F.broadcast(clauses.select("field", "term").distinct()), ["field", "term"]).groupBy("field", "term").agg(F.count("*").alias("df"))
    scored = found.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field")
    scored = scored.withColumn("s", F.col("boost") * bm25(F.col("tf").cast("double"), F.col("doc_len"), F.col("mean_len"), F.col("n_docs"), F.col("df")))
    grouped = scored.groupBy(*keys).agg(F.sum("s").alias("score"), F.max((F.col("kind") == "anchor").cast("int")).alias("a"))
    return grouped.where("a = 1").select(*keys, "score")


def boost(kind: str, weight: float) -> float:
    w = min(1.0, max(0.0, weight))
    return {"anchor": 1.5 + 3.5 * w, "expansion": 0.4 + 2.0 * w, "phrase": 2.0 + 3.0 * w}[kind]


def phrase_match(text: Column, phrase: str) -> Column:
    """Whether the phrase's words stand one after another among the text's."""
    wanted = re.findall(r"[^\W_]+", phrase.lower())
    if not wanted:
        return F.lit(False)
    joined = F.concat(F.lit(" "), F.array_join(body_tokens(text), " "), F.lit(" "))
    return joined.contains(" " + " ".join(wanted) + " ")


def parse_query(query: str) -> tuple[str, list[str]]:
    """``(kind, terms)``: phrase for a quoted query; bad for one that the query language refuses,
    which is an identifier's lookup if it is one; else words."""
    q = query.strip()
    if len(q) >= 2 and q[0] == q[-1] == '"':
        return "phrase", query_terms(q[1:-1])
    refused = q.count('"') % 2 or re.search(r"::|[()\[\]{}^~]|^[*?]|:$|^:", q)
    if refused:
        return ("ident", [q.lower()]) if _IDENT.fullmatch(q) else ("bad", [])
    return "words", query_terms(q)


def search_ident(entries: DataFrame, term: str, query: str) -> DataFrame:
    """All chunks that hold an identifier, by BM25 over identifiers."""
    made = written(chunks(entries), "chunks")
    table = postings(made, "ident", ("wal_entry_id", "chunk_id"), "text").where(F.col("term") == term)
    stats = made.agg(F.lit("ident").alias("field"), F.count("*").alias("n_docs"), F.avg(F.regexp_count("text", F.lit(r"[\w:./\\-]+"))).alias("mean_len"))
    clauses = entries.sparkSession.createDataFrame([("ident", term, 1.0, "anchor")], "field string, term string, boost double, kind string")
    return of_chunks(made.join(bm25_postings(table, stats, clauses), ["wal_entry_id", "chunk_id"]), query)


def search_lexical(entries: DataFrame, query: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """The best chunks by score, then path and place (all of them without a limit, in no order), and whether no query could be
    made of the text, which isn't so where the text is one identifier."""
    kind, terms = parse_query(query)
    if kind == "ident":
        found = search_ident(entries, terms[0], query)
    elif not terms:
        found = entries.sparkSession.createDataFrame([], "wal_entry_id bigint, source_path string, chunk_id int, byte_start bigint, byte_end bigint, line_start int, line_end int, snippet string, score double")
    else:
        found = bm25_scan(entries, terms, query, with_text=kind == "phrase")
        if kind == "phrase":
            found = found.where(phrase_match(F.col("text"), query)).drop("text")
    return found if limit is None else found.orderBy(F.desc(F.round("score", 9)), "source_path", "chunk_id").limit(limit), kind == "bad"


def of_chunks(rows: DataFrame, query: str) -> DataFrame:
    """Scored chunks with their text as rows that show the line for the query."""
    shown = rows.withColumn("_l", first_line_with(F.col("text"), query))
    n = (F.col("line_start") + F.col("_l.k")).cast("int")
    return shown.select("wal_entry_id", "source_path", "chunk_id", "byte_start", "byte_end", n.alias("line_start"), n.alias("line_end"), F.col("_l.line").alias("snippet"), "score")


def first_line_with(text: Column, query: str) -> Column:
    """``struct<k, line>`` of the first line with the whole query, else with any of its words, else the first."""
    whole = query.strip().strip('"')
    words = [w for w in query.split() if w]
    numbered = F.transform(F.split(text, "\n", -1), lambda line, k: F.struct(k.alias("k"), F.regexp_replace(line, "\r$", "").alias("line")))
    exact = F.get(F.filter(numbered, lambda x: x["line"].contains(whole)), F.lit(0)) if whole else F.lit(None)
    some = F.get(F.filter(numbered, lambda x: F.greatest(*[x["line"].contains(w) for w in words], F.lit(False))), F.lit(0)) if words else F.lit(None)
    return F.coalesce(exact, some, F.get(numbered, F.lit(0)))


def verified(text: Column, anchors: list[str], everything: list[str], code_like: bool) -> Column:
    """Whether a variant of an anchor (of any term in code) stands in the lowercased text, or one of its subtokens among the text's."""
    from gleaner.plans.compile import split_subtokens

    variants = everything if code_like else anchors
    inside = [F.lower(text).contains(v.lower()) for v in variants]
    parts = sorted({p for v in variants for p in split_subtokens(v)})
    subs = F.arrays_overlap(subtoken_text(text), F.array(*map(F.lit, parts))) if parts else F.lit(False)
    return F.greatest(*inside, F.lit(False), F.lit(False)) | F.coalesce(subs, F.lit(False))
