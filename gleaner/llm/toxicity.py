"""Toxicity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(cut_k - w . x)``: one weight for each word or prefix, shared by all
ordered cuts. x holds occurrences per hundred words, so a text's score is one sum over its words whatever its
length. The expected severity is the sum of the grades' probabilities times the grades.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import WORD, col, fresh, hold, pieces, small_batches
from gleaner.llm.simhash import MAX_SHARE, WORDS, Fingerprinter

#: At most this many labelled documents, those with the least hash of their id, train the model.
TRAIN_ROWS = 8192
#: Lengths of the prefixes that are features too, so that inflected and compound words count.
PREFIXES = (4, 5, 6, 7)
#: Words and prefixes that fewer of the training documents hold have no weight.
MIN_DOCS = 5
#: A word has a weight only if the log-likelihood ratio of the label and the word's presence in
#: the training documents reaches this, which chance alone rarely does among some thousand words.
MIN_RATIO = 20.0
L2 = 1e-4
STEPS = 300
#: A document is rejected from this probability of any grade above 0.
REJECT = 0.4
_CACHE_WORDS = 200_000


class _WordWeights(dict):
    """Weight of a word: its own and those of its prefixes; recent words are kept."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > _CACHE_WORDS:
            self.clear()
        get, n = self.weights.get, len(word)
        value = self[word] = get(word, 0.0) + sum([get(word[:k] + "*", 0.0) for k in PREFIXES if k <= n])
        return value


@dataclass
class OrdinalModel:
    """Weights by word (``word``) and by prefix (``pref*``), and the ordered cuts between the
    grades; without cuts every grade is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    cuts: list[float] = field(default_factory=list)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - np.array(self.cuts)[None, :], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))]), axis=1)

    def words(self) -> _WordWeights:
        if not hasattr(self, "_of"):
            self._of = _WordWeights(self.weights)
        return self._of

    def scores(self, texts: list[str | None]) -> np.ndarray:
        weight = self.words().__getitem__
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            total, n = 0.0, 0
            for piece in pieces(text or ""):
                found = WORD.findall(piece.lower())
                n += len(found)
                total += sum(map(weight, found))
            out[k] = 100 * total / n if n else 0.0
        return out


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_cols: int, l2: float = L2, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by Adam on the whole (sparse) training set. Grades run from 0 to their
    greatest, and each occurs. Columns are scaled to unit mean square while fitting."""
    n, k = len(grades), int(grades.max())
    scale = 1 / np.sqrt(np.bincount(cols, values**2, minlength=n_cols) / n + 1e-9)
    v = values * scale[cols]
    share = np.cumsum(np.bincount(grades, minlength=k + 1))[:-1] / n
    first = np.log(share / (1 - share))
    # the cuts are the first one plus a running sum of exponentials, which keeps them in order
    p = np.concatenate([np.zeros(n_cols), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, s = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gaps = np.exp(p[n_cols + 1 :])
        cuts = p[n_cols] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(rows, v * p[cols], minlength=n)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = (1 / (1 + np.exp(-np.clip(edges[grades + o] - z, -40, 40))) for o in (1, 0))
        du, dl, prob = upper * (1 - upper), lower * (1 - lower), np.maximum(upper - lower, 1e-12)
        du[grades == k] = 0
        dl[grades == 0] = 0
        g = (du - dl) / prob / n
        dcut = np.bincount(grades, -du / prob, minlength=k + 1)[:k] / n
        dcut += np.bincount(grades, dl / prob, minlength=k + 1)[1:] / n
        tail = np.cumsum(dcut[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, v * g[rows], minlength=n_cols) + l2 * p[:n_cols], tail[:1], tail[1:] * gaps])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return p[:n_cols] * scale, p[n_cols] + np.concatenate([[0], np.cumsum(np.exp(p[n_cols + 1 :]))])


def telling(rows: np.ndarray, cols: np.ndarray, flags: np.ndarray, n_cols: int) -> np.ndarray:
    """The log-likelihood ratio of each column's presence and the flag."""
    on = flags > 0
    n1, n0 = on.sum(), (~on).sum()
    a = np.bincount(cols[on[rows]], minlength=n_cols).astype(float)
    b = np.bincount(cols[~on[rows]], minlength=n_cols).astype(float)
    total = np.zeros(n_cols)
    for x, n, y in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)):
        total += np.where(x > 0, x * np.log(np.maximum(x, 1e-9) * (n1 + n0) / np.maximum(n * y, 1e-9)), 0)
    return 2 * total


def severity_grades(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, flags: np.ndarray, n_cols: int) -> np.ndarray:
    """Grades from a flag alone: 0 where it isn't set; 1 and 2 for the flagged documents that
    hold flagged words at up to and above the flagged documents' median rate. Flagged words are those at
    least eight times as frequent, by documents, where the flag is set."""
    n = np.array([(flags == 0).sum(), (flags > 0).sum()])
    docs = [np.bincount(cols[(flags[rows] > 0) == on], minlength=n_cols) for on in (False, True)]
    flagged = (docs[1] + 0.5) / (n[1] + 1) >= 8 * (docs[0] + 0.5) / (n[0] + 1)
    rate = np.bincount(rows, values * flagged[cols], minlength=len(flags))
    on = rate[(flags > 0) & (rate > 0)]
    return np.where(flags == 0, 0, np.where(rate > (np.median(on) if len(on) else 0), 2, 1))


def _word_counts(rows: DataFrame) -> DataFrame:
    """Of rows ``(label, text)``: the label, the distinct words, their counts per hundred, and
    the text's fingerprint."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None)
        prints = Fingerprinter(WORDS)
        for batch in it:
            found, rates, marks = [], [], []
            for text in batch.column(1):
                counts: Counter[str] = Counter()
                for piece in pieces(text.as_py() or ""):
                    counts.update(WORD.findall(piece.lower()))
                n = max(1, counts.total())
                found.append(list(counts))
                rates.append([100 * c / n for c in counts.values()])
                mark = prints.one(text.as_py())
                marks.append(np.zeros(WORDS, np.int64) if mark is None else mark)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(rates, pa.list_(pa.float32())), pa.array(marks, pa.list_(pa.int64()))], names=["label", "words", "rates", "mark"])

    return rows.mapInArrow(batches, "label int, words array<string>, rates array<float>, mark array<bigint>")


def one_of_each(marks: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of near copies, and the group's median label. A wrong label
    that a text's copies share would else look like many."""
    left, firsts, labels = np.ones(len(marks), bool), [], []
    limit = int(MAX_SHARE * marks.shape[1] * 63)
    for k in range(len(marks)):
        if left[k]:
            rest = np.flatnonzero(left)
            group = rest[np.bitwise_count((marks[rest] ^ marks[k]).view(np.uint64)).sum(1) <= limit]
            left[group] = False
            firsts.append(k)
            labels.append(int(np.sort(flags[group])[len(group) // 2]))
    return np.array(firsts), np.array(labels, np.int64)


def fit_severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", graded: bool = False, train_rows: int = TRAIN_ROWS, min_docs: int = MIN_DOCS) -> OrdinalModel:
    """A model from labelled documents. ``graded``: the label is an ordinal grade from 0; else it
    is a flag, refined by ``severity_grades``. Of several labels of a document the greatest counts; null labels
    and ids don't. Labels of one value only, or none, give a model that finds nothing.

    The sample is bounded by ``train_rows``, so its ids may be broadcast and its words collected."""
    small_batches(docs.sparkSession)
    one = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).cast("int").alias("label"))
    picked = one.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    text = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("text is not null")
    # at most train_rows rows of words and numbers
    table = _word_counts(text.join(F.broadcast(picked), "id").select("label", "text")).toArrow()
    if not len(table):
        return OrdinalModel()
    marks = pa.compute.list_flatten(table.column("mark").combine_chunks()).to_numpy().reshape(-1, WORDS)
    firsts, flags = one_of_each(marks, table.column("label").to_numpy().astype(np.int64))
    if len(np.unique(flags)) < 2:
        return OrdinalModel()
    table = table.take(pa.array(firsts))
    lists = table.column("words").combine_chunks()
    codes = pa.compute.list_flatten(lists).dictionary_encode()
    rows = np.repeat(np.arange(len(flags), dtype=np.int32), pa.compute.list_value_length(lists).to_numpy())
    cols = codes.indices.to_numpy()
    values = pa.compute.list_flatten(table.column("rates").combine_chunks()).to_numpy()
    del table, lists
    names: list[str] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in (0, *PREFIXES):
        words = codes.dictionary
        long = np.ones(len(words), bool) if not size else pa.compute.utf8_length(words).to_numpy() >= size
        starts = (words if not size else pa.compute.utf8_slice_codeunits(words, 0, size)).dictionary_encode()
        of, width = starts.indices.to_numpy(), len(starts.dictionary)
        some = long[cols]
        keys = rows[some].astype(np.int64) * width + of[cols[some]]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        v = np.add.reduceat(values[some][order], first, dtype=np.float64) if len(first) else np.zeros(0)
        r, c = keys[first] // max(1, width), keys[first] % max(1, width)
        del keys, order
        ok = (np.bincount(c, minlength=width) >= min_docs) & (telling(r, c, flags, width) >= MIN_RATIO)
        keep = ok[c]
        found.append((r[keep], (np.cumsum(ok) - 1)[c[keep]] + len(names), v[keep]))
        names += [w + "*" * bool(size) for w in starts.dictionary.filter(pa.array(ok)).to_pylist()]
    if not names:
        return OrdinalModel()
    rows, cols, values = (np.concatenate(x) for x in zip(*found, strict=True))
    grades = flags if graded else severity_grades(rows, cols, values, flags, len(names))
    grades = np.unique(grades, return_inverse=True)[1]
    weights, cuts = fit_cumulative_link(rows, cols, values, grades, len(names))
    return OrdinalModel(dict(zip(names, weights.tolist(), strict=True)), cuts.tolist())


def with_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text", name: str = "severity") -> DataFrame:
    """``docs`` and a struct: the expected severity, the likeliest grade, and whether the
    probability of a grade above 0 reaches ``REJECT``. Null, empty and wordless texts score like a text without known words. Long texts
    count whole, in pieces. Repeated rows stay, each with the same struct; of grades equally likely the least is taken; an empty table stays empty. Only the
    text goes through Python, so no column can clash but one that has the name, which is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("expected", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("rejected", T.BooleanType())])

    @F.arrow_udf(kind)
    def severity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        hold(m.words())
        for column in texts:
            p = m.probabilities(m.scores(column.to_pylist())) if m.cuts else np.ones((len(column), 1))
            expected = p @ np.arange(p.shape[1])
            yield pa.StructArray.from_arrays([pa.array(expected), pa.array(p.argmax(1).astype(np.int32)), pa.array((1 - p[:, 0] >= REJECT) & (p.shape[1] > 1))], names=["expected", "grade", "rejected"])

    return docs.withColumn(name, severity(col(text_col).cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params: object) -> DataFrame:
    """``docs`` without the rows that a model of ``labels`` rejects; columns stay as they are, and their names can't clash. Null and
    empty texts stay, repeated rows stay or go together, long texts count whole, and no documents or no labels drop nothing."""
    (name,) = fresh(docs, "severity")
    scored = with_severity(docs, fit_severity(docs, labels, id_col, text_col, **params), text_col, name)
    return scored.where(~F.col(f"{name}.rejected")).drop(name)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, likeliest grade and rejection of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_severity(docs, model).select("doc_id", F.col("severity.expected").alias("expected_severity"), "severity.grade", "severity.rejected")
