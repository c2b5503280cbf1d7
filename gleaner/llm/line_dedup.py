"""Line dedup by pairwise alignment: documents that share lines are aligned by patience diff,
and the later one loses the common blocks.

Each line of at least ``min_chars`` characters (white space collapsed) is hashed. A hash that two
documents or more hold belongs to the earliest of them, its owner, and every later holder is
paired with the owner. A document thus has at most one partner per shared line, however many
documents share it: the number of pairs never exceeds the number of lines, so no line is too
frequent to pair by. Each pair is aligned over its shared lines (rare ones, which stand once in
both, are the anchors), and aligned runs are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col, fresh, small_batches, written

MIN_CHARS = 20


def line_hashes(text: str, min_chars: int = MIN_CHARS) -> dict[int, list[int]]:
    """Hash of each line that is long enough: where it stands, counted from 0."""
    at: dict[int, list[int]] = {}
    for k, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(line := " ".join(line.split())) >= min_chars:
            at.setdefault(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63), []).append(k)
    return at


def line_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, th, h, at)``: a row for each document and distinct line hash in it, with the line
    numbers. Null ids and null texts give none."""
    small_batches(docs.sparkSession)
    rows = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("th", T.LongType()), T.StructField("h", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows_of, hashes, at = [], [], []
            for k, text in enumerate(batch.column(2)):
                found = line_hashes(text.as_py(), min_chars)
                rows_of += [k] * len(found)
                hashes += found.keys()
                at += found.values()
            take = pa.array(rows_of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["id", "th", "h", "at"])

    return rows.mapInArrow(batches, schema)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of ``pairs``, sorted by their first, in which the second increases."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        back.append(ends[n - 1] if n else -1)
        if n == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[n], ends[n] = y, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(later: list[int], earlier: list[int]) -> list[tuple[int, int]]:
    """The pairs of places that patience diff aligns in two sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(later), 0, len(earlier))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and later[a0] == earlier[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and later[a1 - 1] == earlier[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        mine, other = Counter(later[a0:a1]), Counter(earlier[b0:b1])
        where = {earlier[j]: j for j in range(b0, b1) if other[earlier[j]] == 1}
        anchors = _increasing([(i, where[later[i]]) for i in range(a0, a1) if mine[later[i]] == 1 and later[i] in where])
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if anchors:
                todo.append((i0 + 1, i1, j0 + 1, j1))
        out += anchors
    return sorted(out)


def aligned_lines(shared: list[tuple[object, int, list[int], list[int]]]) -> list[int]:
    """Line numbers to delete from a document, given for each shared line its owner, its hash and
    its places in the document and in the owner."""
    by: defaultdict[object, list[tuple[int, list[int], list[int]]]] = defaultdict(list)
    for owner, h, at, there in shared:
        by[owner].append((h, at, there))
    gone: set[int] = set()
    for lines in by.values():
        a = sorted((k, h) for h, at, _ in lines for k in at)
        b = sorted((k, h) for h, _, there in lines for k in there)
        gone.update(a[i][0] for i, _ in patience([h for _, h in a], [h for _, h in b]))
    return sorted(gone)


def lines_to_delete(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(id, th, gone)`` for each document that loses lines; gone is true at the places of these.

    The later of two documents is the one with the greater id; with the same id, that whose
    text has the greater hash. Rows with the same id and text are one document."""
    postings = written(line_postings(docs, id_col, text_col, min_chars), "line-postings")
    key = F.struct("id", "th")
    owners = postings.groupBy("h").agg(F.min(F.struct("id", "th", "at")).alias("own"), F.max(key).alias("last")).where(F.struct("own.id", "own.th") != F.col("last")).drop("last")
    held = postings.join(owners, "h").where(key != F.struct("own.id", "own.th"))
    shared = held.groupBy("id", "th").agg(F.collect_set(F.struct(F.xxhash64("own.id", "own.th").alias("owner"), "h", "at", F.col("own.at").alias("there"))).alias("shared"))

    @F.arrow_udf("array<boolean>")
    def marks(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            lines = aligned_lines([(x["owner"], x["h"], x["at"], x["there"]) for x in row.as_py()])
            mask = np.zeros(lines[-1] + 1 if lines else 0, bool)
            mask[lines] = True
            out.append(mask)
        return pa.array(out, pa.list_(pa.bool_()))

    return shared.select("id", "th", marks("shared").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, deleted_col: str | None = None) -> DataFrame:
    """``docs`` with the aligned common lines deleted from every later document.

    Other columns stay as they are. ``deleted_col`` adds the number of lines deleted. Documents
    without shared lines, with a null id or with a null or empty text come back unchanged; a document of
    which all lines are deleted comes back with an empty text. Repeated rows (same id and text) are one document and come back alike.
    A text of any length is hashed and cut whole; an empty table stays empty. Helper columns get names that no column has; a column
    that has the name ``deleted_col`` must not be there. The documents are shuffled once."""
    gone = lines_to_delete(docs, id_col, text_col, min_chars)
    rid, rth, rgone = fresh(docs, "id", "th", "gone")
    gone = gone.select(F.col("id").alias(rid), F.col("th").alias(rth), F.col("gone").alias(rgone))
    joined = docs.join(gone.hint("shuffle_hash"), (col(id_col) == F.col(rid)) & (F.xxhash64(col(text_col)) == F.col(rth)), "left")
    left = F.array_join(F.filter(F.split(col(text_col), "\n", -1), lambda line, k: ~F.coalesce(F.get(F.col(rgone), k), F.lit(False))), "\n")
    out = [F.when(F.col(rgone).isNull(), col(c)).otherwise(left).alias(c) if c == text_col else col(c) for c in docs.columns]
    if deleted_col:
        out.append(F.when(F.col(rgone).isNull(), 0).otherwise(F.size(F.filter(F.col(rgone), lambda x: x))).alias(deleted_col))
    return joined.select(*out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as it is after line dedup, with the number of lines it lost."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, deleted_col="n_deleted")
