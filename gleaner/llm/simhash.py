"""Near-duplicate removal: SimHash fingerprints, pigeonhole blocks, Hamming verification.

A document's features are its distinct words (of a text without any, the stripped text), each weighing as much
as it has letters, up to ``MAX_LETTERS``: long words tell texts apart, short ones all texts of a language share.
Each feature has as many hashed bits as the fingerprint; a bit is set if more than half of the weight sets it.
Fingerprints hold ``words`` longs of 63 bits. Two that differ in at most ``MAX_SHARE`` of the bits are near.

Near fingerprints only nominate a pair. It counts if the texts agree in all their words with order
and number: each document has a sketch of its shingles of ``SHINGLE`` words (the n-th use of a
shingle is a feature of its own), a minimum for each of ``LANES`` parts of the hash range, and
``MIN_SIMILARITY`` of the lanes that either document fills must be equal. That estimates the Jaccard
similarity of the shingles, and is nearly exact for short texts.

Pairs are looked for by what both must have, so that none is missed. Blocks of the fingerprint can't do that: blocks so narrow that one
is untouched in every pair at ``MAX_SHARE`` would hold six bits, and each a fiftieth of the corpus. Sketches can: of lanes of which 0.3 are
equal, dealt out to one group fewer than there are equal ones, two equal ones share a group. So the pairs of lanes within
groups are keys of 30 bits (``key_levels``), of which any pair that counts shares one, and all rows that share a key are
compared. Up to ``CROWD`` rows give their pairs, which meet their fingerprints by joins. More rows get their fingerprints and sketches first and are
compared where they lie, in tiles, so that a key of any frequency is many tasks and only links are written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import WORD, col, hold, pieces, small_batches, written
from gleaner.llm.components import connected_components

WORDS = 16
PER_WORD = 3
#: Letters of a word beyond which it weighs no more.
MAX_LETTERS = 12
#: Share of the fingerprint's bits in which near duplicates may differ.
MAX_SHARE = 0.15
SHINGLE = 3
LANES = 128
#: Estimated shingle similarity from which a pair of near fingerprints counts as near duplicates.
MIN_SIMILARITY = 0.3
_CACHE_WORDS = 150_000
_ROWS = 1024
#: Rows of a block that are compared with as many others by one task at a time.
TILE = 1024
#: Least numbers of filled lanes of the levels of keys: a sketch has keys for each level that a partner may bring it to.
LEVELS = (1, 4, 7, 17, 27, 47, 71, 104)
#: Rows of a hot key, compared in the same way; they travel with their fingerprints and sketches, once for each tile of the key.
HOT_TILE = 4096
#: Rows that share a key beyond which they are compared where they lie.
CROWD = 32
#: Keys of the same level that a hot key looks at before its own: pairs that share one of them are left to it.
EARLIER = 16


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big")


class _Bits(dict):
    """Rows of tables of hashed bits, weights and 64-bit hashes by feature; a feature that isn't there yet gets the next one."""

    def __init__(self, words: int) -> None:
        self.size, self.table = words * 8, np.zeros((_CACHE_WORDS, words * 8), np.uint8)
        self.weights, self.hashes = np.zeros(_CACHE_WORDS, np.uint16), np.zeros(_CACHE_WORDS, np.uint64)

    def __missing__(self, feature: str) -> int:
        n, raw = len(self), feature.encode("utf-8", "surrogatepass")
        self[feature] = n
        self.table[n] = np.frombuffer(hashlib.shake_128(raw).digest(self.size), np.uint8)
        self.weights[n], self.hashes[n] = min(len(feature), MAX_LETTERS), _hash(raw)
        return n


class Fingerprinter:
    """Fingerprints of batches of texts; the hashed bits of recent words are kept packed."""

    def __init__(self, words: int) -> None:
        self.words, self.at = words, _Bits(words)

    def _votes(self, features: list[str], weights: np.ndarray) -> np.ndarray:
        """The weight that sets each bit, added up in 16 bits for ``_ROWS`` features at a time."""
        total = np.zeros(self.words * 64, np.int64)
        for k in range(0, len(features), _ROWS):
            part = features[k : k + _ROWS]
            if len(self.at) + len(part) > _CACHE_WORDS:
                self.at.clear()
            total += self._sum(np.fromiter(map(self.at.__getitem__, part), np.int64, len(part)), weights[k : k + _ROWS].astype(np.uint16))
        return total

    def _sum(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.einsum("i,ij->j", weights, np.unpackbits(self.at.table[rows], axis=1), dtype=np.uint16, casting="unsafe")

    @staticmethod
    def _print(votes: np.ndarray, weight: int) -> np.ndarray:
        bits = votes * 2 > weight
        bits[::64] = False
        return np.packbits(bits).view(">i8").astype(np.int64)

    def one(self, text: str | None) -> np.ndarray | None:
        if not text or not text.strip():
            return None
        found: set[str] = set()
        for piece in pieces(text):
            found.update(WORD.findall(piece.lower()))
        features = list(found) or [text.strip()]
        weights = np.minimum(np.fromiter(map(len, features), np.int64, len(features)), MAX_LETTERS)
        return self._print(self._votes(features, weights), weights.sum())

    def both(self, text: str | None, sketcher: Sketcher) -> tuple[np.ndarray | None, bytes | None]:
        """Fingerprint and sketch; the words of a text that fits the table are looked up once for the two."""
        words = WORD.findall(text.lower()) if text and len(text) <= _CACHE_WORDS else []
        if not words:
            return self.one(text), sketcher.one(text)
        if len(self.at) + len(words) > _CACHE_WORDS:
            self.at.clear()
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        found = np.unique(rows)
        weights, votes = self.at.weights[found], np.zeros(self.words * 64, np.int64)
        for k in range(0, len(found), _ROWS):
            votes += self._sum(found[k : k + _ROWS], weights[k : k + _ROWS])
        return self._print(votes, weights.sum(dtype=np.int64)), sketcher.of(self.at.hashes[rows])


class _Hashes(dict):
    """64-bit hashes of words, those of recent words kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        found = self[word] = _hash(word.encode("utf-8", "surrogatepass"))
        return found


class Sketcher:
    """Sketches of all shingles of a text."""

    def __init__(self) -> None:
        self.at = _Hashes()

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def one(self, text: str | None) -> bytes | None:
        if not text or not text.strip():
            return None
        parts = [np.fromiter(map(self.at.__getitem__, WORD.findall(piece.lower())), np.uint64) for piece in pieces(text)]
        words = np.concatenate(parts)
        if not len(words):
            words = np.array([self.at[text.strip()]], np.uint64)
        return self.of(words)

    def of(self, words: np.ndarray) -> bytes:
        """The sketch of a text with words of these hashes."""
        width = min(SHINGLE, len(words))
        marks = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            marks = self._mix(marks + words[k : len(words) - width + 1 + k])
        marks.sort()
        first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        use = np.arange(len(marks)) - np.repeat(first, np.diff(np.append(first, len(marks))))
        marks = np.sort(self._mix(marks + use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        lanes, at = np.unique(marks // np.uint64((1 << 64) // LANES), return_index=True)
        out = np.zeros(LANES, "<u2")
        out[lanes.astype(np.int64)] = (marks[at] & np.uint64(0x7FFF)) + np.uint64(1)
        return out.tobytes()


def similarity(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The share of the lanes filled in either of two sketches that are equal, pair by pair."""
    x, y = (np.frombuffer(b"".join(s), "<u2").reshape(-1, LANES) for s in (a, b))
    return ((x == y) & (x > 0)).sum(axis=1) / np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, th, f0, f1, ..., sketch)`` for each row: its id, a hash of its text, its fingerprint, its
    sketch of shingles. A null, empty or blank text has a null fingerprint and sketch."""
    small_batches(docs.sparkSession)
    names = [f"f{k}" for k in range(words)]
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("th", T.LongType()), *[T.StructField(n, T.LongType()) for n in names], T.StructField("sketch", T.BinaryType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(None)
        made, sketcher = Fingerprinter(words), Sketcher()
        for batch in it:
            marks = [made.both(t.as_py(), sketcher) for t in batch.column(2)]
            prints, sketches = [p for p, _ in marks], [s for _, s in marks]
            null = np.array([p is None for p in prints], bool)
            table = np.array([np.zeros(words, np.int64) if p is None else p for p in prints], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(table[:, k], mask=null) for k in range(words)], pa.array(sketches, pa.binary())], names=["id", "th", *names, "sketch"])

    return rows.mapInArrow(batches, schema)


def _distance(a: str, b: str, words: Iterable[int]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.f{k}").bitwiseXOR(F.col(f"{b}.f{k}"))) for k in words], F.lit(0))


def block_keys(words: int = WORDS, per_word: int = PER_WORD) -> list[Column]:
    """For approximate search by fingerprints alone; ``near_links`` doesn't use it. The blocks of a row ``(f0, ...)``, each with its number above its bits: of runs of neighbouring bits,
    then, where longs can be cut into three times as many parts, of three parts from different longs."""
    width = 63 // per_word

    def part(k: int, at: int, n: int) -> Column:
        return F.shiftright(f"f{k % words}", at).bitwiseAND(F.lit((1 << n) - 1))

    keys = [part(k, width * j, width) for k in range(words) for j in range(per_word)]
    third = width // 3
    if third * 3 == width and words >= 3:
        step, parts = words // 3, 3 * per_word
        for k in range(words):
            for j in range(per_word):
                thirds = [part(k + step * t, third * ((j + per_word * t) % parts), third) for t in range(3)]
                keys.append(thirds[0] + F.shiftleft(thirds[1], third) + F.shiftleft(thirds[2], 2 * third))
    return [key + F.lit(n << width).cast("long") for n, key in enumerate(keys)]


def second_key_bits(max_share: float = MAX_SHARE) -> int:
    """For approximate search, as ``block_keys``. Bits in which the second keys of a pair may differ: at ``max_share`` one pair in a thousand exceeds it by chance, and
    meets in other blocks."""
    return math.ceil(63 * max_share + 3 * math.sqrt(63 * max_share * (1 - max_share)))


def key_levels(least: float = MIN_SIMILARITY) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(low, high, i, j)`` for each level of ``LEVELS``: pairs of lanes, of which two sketches that agree to at least ``least`` share one
    in all. The fuller of the two has ``low`` to ``high`` lanes, so at least ``least * low`` lanes are equal, and the lanes are dealt out to
    one group fewer than that: two of the equal ones lie in the same group. Where a single equal lane is enough, i and j are the same."""
    out = []
    for low, high in zip(LEVELS, [*(n - 1 for n in LEVELS[1:]), LANES], strict=True):
        equal = next(e for e in range(1, low + 1) if e / low >= least)
        i, j = np.triu_indices(LANES, 0 if equal == 1 else 1)
        inside = i == j if equal == 1 else i % (equal - 1) == j % (equal - 1)
        out.append((low, high, i[inside], j[inside]))
    return out


def sketch_keys(prints: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """``(key, rep)``: the keys of each row ``(rep, sketch)``. Rows whose sketches agree to at least ``least`` share a key, without exception."""
    levels = key_levels(least)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                reps = part.column(0).to_numpy()
                lanes = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, LANES)
                filled = (lanes > 0).sum(axis=1)
                for n, (low, high, i, j) in enumerate(levels):
                    here = np.flatnonzero((filled <= high) & (filled / low >= least))
                    if len(here):
                        x, y = lanes[here][:, i], lanes[here][:, j]
                        row, at = np.nonzero((x > 0) & (y > 0))
                        keys = ((n << 13) + at << 30) + (x[row, at].astype(np.int64) - 1 << 15) + y[row, at] - 1
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps[here[row]])], names=["key", "rep"])

    return prints.select("rep", "sketch").mapInArrow(batches, "key bigint, rep bigint")


def _tiles(rows: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(at, n, ...)`` numbered from 1 to n within their group, twice: each tile of ``tile`` rows with itself and with each earlier one, as
    ``(s, t)``, s the earlier; the first table has the rows of s, the second those of t."""
    rows = rows.withColumns({"tile": F.floor((F.col("at") - 1) / tile).cast("int"), "last": F.floor((F.col("n") - 1) / tile).cast("int")}).drop("at", "n")
    x = rows.withColumns({"s": F.col("tile"), "t": F.explode(F.sequence("tile", "last"))}).drop("tile", "last")
    y = rows.withColumns({"s": F.explode(F.sequence(F.lit(0), "tile")), "t": F.col("tile")}).drop("tile", "last")
    return x, y.toDF(*y.columns)


def _near(x: pa.Table, y: pa.Table, words: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of two tiles, whether each of the one is near each of the other, and the distances. Of a tile with itself
    each pair counts once, as does one of two tiles."""
    a, b = x["rep"].to_numpy(), y["rep"].to_numpy()
    distance = np.zeros((len(a), len(b)), np.uint16)
    for k in range(words):
        distance += np.bitwise_count(x[f"f{k}"].to_numpy()[:, None] ^ y[f"f{k}"].to_numpy()[None, :])
    near = distance <= most
    if x["s"][0].as_py() == x["t"][0].as_py():
        near &= a[:, None] < b[None, :]
    return a, b, near, distance


def most_bits(words: int, max_share: float) -> int:
    """Bits in which near fingerprints may differ."""
    return int(max_share * words * 63)


def near_pairs(prints: DataFrame, words: int = WORDS, max_share: float = MAX_SHARE, tile: int = TILE) -> DataFrame:
    """``(a, b, distance)`` for all pairs a < b of rows ``(rep, f0, ...)``, rep a number, that differ in at most ``max_share`` of the
    bits. Every row is compared with every other, tile by tile, so no pair is missed and the work is quadratic: for tables that have
    fingerprints only. With sketches ``near_links`` finds what counts without comparing all."""
    names, most = [f"f{k}" for k in range(words)], most_bits(words, max_share)
    everything = Window.partitionBy("root")
    rows = prints.select("rep", *names, F.lit(0).cast("long").alias("root"))
    x, y = _tiles(rows.withColumns({"n": F.count("*").over(everything), "at": F.row_number().over(everything.orderBy("rep"))}), tile)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
        a, b, near, distance = _near(x, y, words, most)
        i, j = np.nonzero(near)
        return pa.table({"a": a[i], "b": b[j], "distance": distance[i, j].astype(np.int32)})

    return x.groupBy("root", "s", "t").cogroup(y.groupBy("root", "s", "t")).applyInArrow(compare, "a bigint, b bigint, distance int")


def alike(pairs: DataFrame, prints: DataFrame, words: int, most: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of rows ``(rep, f0, ..., sketch)`` that count. Half of each fingerprint goes first: where it differs in more than ``most``
    bits, so does the whole, and chance pairs, which are most, carry no more than that."""
    first, rest = range(words // 2), range(words // 2, words)

    def met(pairs: DataFrame, *names: str) -> DataFrame:
        of = prints.select("rep", *names)
        return pairs.join(of.alias("p"), F.col("a") == F.col("p.rep")).join(of.alias("q"), F.col("b") == F.col("q.rep"))

    near = met(pairs, *[f"f{k}" for k in first]).select("a", "b", _distance("p", "q", first).alias("d")).where(F.col("d") <= most)
    near = met(near, *[f"f{k}" for k in rest], "sketch").where(F.col("d") + _distance("p", "q", rest) <= most)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                good = similarity(batch.column(2).to_pylist(), batch.column(3).to_pylist()) >= least
                yield batch.select([0, 1]).filter(pa.array(good))

    return near.select("a", "b", F.col("p.sketch").alias("x"), F.col("q.sketch").alias("y")).mapInArrow(batches, "a bigint, b bigint")


def _lanes(sketches: list[bytes]) -> np.ndarray:
    """Sketches, lane by lane."""
    return np.ascontiguousarray(np.frombuffer(b"".join(sketches), "<u2").reshape(-1, LANES).T)


def hot_links(hot: DataFrame, prints: DataFrame, words: int, most: int, least: float, tile: int = HOT_TILE) -> DataFrame:
    """``(a, b)``: the links a < b among rows ``(key, rep, n, at)`` that share a key. A pair that shares earlier keys of the level, too, as versions of
    one text do, is left to the first of them, so that it is written about once, not once a key. A pair may still come twice."""
    names, levels = [f"f{k}" for k in range(words)], key_levels(least)
    place = lambda c: F.floor((F.col(c) - 1) / tile).cast("int")
    rows = hot.select("key", "rep", place("at").alias("tile"), F.explode(F.sequence(F.lit(0), place("n"))).alias("other"))
    rows = rows.select("key", "rep", "tile", F.least("tile", "other").alias("s"), F.greatest("tile", "other").alias("t"))

    def links(key: int, x: pa.Table, y: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, _, i, j = levels[key >> 43]
        at = key >> 30 & 8191
        made = [(z["rep"].to_numpy(), np.stack([z[n].to_numpy() for n in names], axis=1), _lanes(z["sketch"].to_pylist())) for z in (x, y)]
        for k in range(0, x.num_rows, _ROWS):
            for m in range(k if same else 0, y.num_rows, _ROWS):
                (a, f, p), (b, g, q) = ((ids[o : o + _ROWS], bits[o : o + _ROWS], lanes[:, o : o + _ROWS]) for (ids, bits, lanes), o in zip(made, (k, m), strict=True))
                left = a[:, None] < b[None, :]
                for e in range(min(at, EARLIER)):
                    if not left.any():
                        break
                    u, v = i[e], j[e]
                    left &= ~((p[u, :, None] == q[u, None, :]) & (p[v, :, None] == q[v, None, :]) & ((p[u] > 0) & (p[v] > 0))[:, None])
                one, two = np.nonzero(left)
                for c in range(0, len(one), 1 << 15):
                    r, s = one[c : c + (1 << 15)], two[c : c + (1 << 15)]
                    near = np.bitwise_count(f[r] ^ g[s]).sum(axis=1) <= most
                    r, s = r[near], s[near]
                    v, w = p[:, r], q[:, s]
                    good = ((v == w) & (v > 0)).sum(axis=0) / np.maximum(((v > 0) | (w > 0)).sum(axis=0), 1) >= least
                    yield a[r[good]], b[s[good]]

    def compare(group: pa.Table) -> pa.Table:
        same = group["s"][0].as_py() == group["t"][0].as_py()
        group = group.sort_by("rep")
        x, y = (group, group) if same else (group.filter(pc.equal(group["tile"], group[c][0])) for c in "st")
        found = list(links(group["key"][0].as_py(), x, y, same))
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *[z[n] for z in found]]) for n, c in enumerate("ab")})

    return rows.join(prints.select("rep", *names, "sketch"), "rep").groupBy("key", "s", "t").applyInArrow(compare, "a bigint, b bigint")


def near_links(prints: DataFrame, words: int = WORDS, max_share: float = MAX_SHARE, least: float = MIN_SIMILARITY, tile: int = HOT_TILE, crowd: int = CROWD) -> DataFrame:
    """``(a, b, n)``: all links between rows ``(rep, f0, ..., sketch)``, rep a number, that is, pairs that differ in at most ``max_share`` of the bits
    and whose sketches agree to at least ``least``, from either side. n is 1.

    All rows that share a key of their sketches are compared, however many; keys of one row, which are most, go before anything is
    joined. ``crowd`` decides how rows are compared, not whether."""
    most = most_bits(words, max_share)
    inside = Window.partitionBy("key")
    placed = sketch_keys(prints, least).withColumns({"n": F.count("*").over(inside), "at": F.row_number().over(inside.orderBy("rep"))}).where("n > 1")
    placed = written(placed, "shared-keys")
    few = placed.where(F.col("n") <= crowd).select("key", "rep")
    meet = few.withColumnRenamed("rep", "a").join(few.withColumnRenamed("rep", "b"), "key").where("a < b").select("a", "b").distinct()
    pairs = alike(written(meet, "pairs"), prints, words, most, least)
    hot = placed.where(F.col("n") > crowd)
    if not hot.isEmpty():
        pairs = pairs.unionByName(hot_links(hot, prints, words, most, least, tile)).distinct()
    return pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).withColumn("n", F.lit(1).cast("long"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_share: float = MAX_SHARE, only: DataFrame | None = None) -> DataFrame:
    """``(id, th, group_id, keep, n_links)`` for each row of ``docs``: the least id of its group of near
    duplicates, which are chains of near pairs, whether it is the one to stay, and of how many texts with
    another fingerprint or sketch its own is a near copy.

    Null, empty and blank texts and null ids are groups of their own and stay. Rows with the same
    id and text are one document; rows with the same id and different texts are ordered by a hash
    of the text. Texts of any length count whole, in pieces. An empty table has no groups. Only the id and the text are read, under new
    names, so other columns can't clash. Rows with equal fingerprints and sketches fall together before any pairs are made, so a group of any
    number of exact copies costs one row. Other near pairs count if their sketches are similar. Such rows get numbers, which are kept by writing them.
    ``only``: ids (column ``id``) outside of which documents don't count."""
    names = [f"f{k}" for k in range(words)]
    marks = written(fingerprints(docs, id_col, text_col, words).withColumn("all", F.xxhash64(*names, "sketch")), "fingerprints")
    if only is not None:
        marks = marks.join(only.select("id"), "id", "left_semi")
    some = marks.where("id is not null and f0 is not null")
    key = F.struct("id", "th")
    firsts = some.groupBy("f0", "all").agg(F.min(key).alias("first"), *[F.first(n).alias(n) for n in [*names[1:], "sketch"]])
    prints = written(firsts.withColumn("rep", F.monotonically_increasing_id()), "distinct-fingerprints")
    links = written(near_links(prints, words, max_share), "links")
    roots = connected_components(links)
    inside = roots.join(prints.select(F.col("rep").alias("node"), "first"), "node")
    leads = inside.join(inside.groupBy("root").agg(F.min("first").alias("lead")), "root").select(F.col("node").alias("rep"), "lead")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    reps = prints.select("f0", "all", "rep", "first").join(leads.join(counts, "rep"), "rep", "left")
    reps = reps.select("f0", "all", F.coalesce("lead", "first").alias("lead"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    grouped = some.select("id", "th", "f0", "all").join(reps, ["f0", "all"]).select("id", "th", F.col("lead.id").alias("group_id"), (key == F.col("lead")).alias("keep"), "n_links")
    alone = marks.where("id is null or f0 is null").select("id", "th", F.col("id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", originals: DataFrame | None = None, **params: float) -> DataFrame:
    """``docs`` without the rows of which another of the group stays; of repeated rows (same id,
    same text) one stays, unless their text is null or blank or their id is null. Columns stay as they are. Texts of any
    length count whole; an empty table stays empty.

    ``originals``: the documents as they were before lines were cut from them, which hides what is left of a near copy.
    A document is judged by its text there, among the documents that ``docs`` still has. Documents with a null or repeated id
    are judged by their text in ``docs``, among themselves.

    Only ids and hashes of the rows to drop are shuffled to the documents, which are hashed once."""
    if originals is not None:
        ids = lambda df: df.select(col(id_col).alias("id")).where("id is not null").groupBy("id").count().where("count = 1").select("id")
        once = written(ids(docs).join(ids(originals), "id", "left_semi"), "ids")
        gone = near_duplicate_groups(originals, id_col, text_col, only=once, **params).where(~F.col("keep")).select("id")
        kept = docs.join(gone.hint("shuffle_hash"), col(id_col) == gone["id"], "left_anti")
        rest = docs.join(once, col(id_col) == once["id"], "left_anti")
        if docs.select(id_col).join(once, col(id_col) == once["id"], "left_anti").isEmpty():
            return kept
        return kept.join(once, col(id_col) == once["id"], "left_semi").unionByName(drop_near_duplicates(rest, id_col, text_col, **params))
    groups = written(near_duplicate_groups(docs, id_col, text_col, **params), "groups")
    named = F.col("id").isNotNull() & F.col("group_id").isNotNull()
    gone = groups.where(~F.col("keep")).select("id", "th").distinct()
    kept = docs.join(gone.hint("shuffle_hash"), (col(id_col) == gone["id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == gone["th"]), "left_anti")
    again = groups.where(F.col("keep") & named).groupBy("id", "th").count().where("count > 1").select("id", "th")
    if again.isEmpty():
        return kept
    twice = kept.join(again, (col(id_col) == again["id"]) & (F.xxhash64(kept[f"`{text_col}`"]) == again["th"]) & (F.trim(kept[f"`{text_col}`"]) != ""), "left_semi")
    once = kept.join(again, (col(id_col) == again["id"]) & (F.xxhash64(kept[f"`{text_col}`"]) == again["th"]) & (F.trim(kept[f"`{text_col}`"]) != ""), "left_anti")
    return once.unionByName(twice.dropDuplicates([id_col, text_col]))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the least doc_id of its group of near duplicates, whether it stays, and the number of its links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs).select(F.col("id").alias("doc_id"), "group_id", "keep", "n_links")
