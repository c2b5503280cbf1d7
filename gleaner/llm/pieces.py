"""SentencePiece BPE encoding and decoding in numpy.

A batch's new words are encoded together: one flat array of symbols and one of the words they
stand in. Each round looks up the rank of every adjacent pair, takes the least rank in each word,
merges its leftmost occurrences that don't overlap in all words at once, and takes the finished
words out, until no pair is left. Where a merge makes a pair of the same or a better rank, which would
have come before the word's next occurrence, that word merges its first occurrence only; so
the ids are those of merging one pair at a time.

Pieces never hold a space mark after another letter, so words (runs of space marks and the
letters up to the next) can be encoded apart, and each distinct word once.
"""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col, hold, small_batches

MODEL = os.environ.get("GLEANER_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
_SHIFT = 21
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_NONE = int(np.iinfo(np.int32).max)
_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CACHE_WORDS = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("gleaner-each-byte", _each_byte)


def _cuckoo(keys: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """Two tables of places in ``keys``, of which one has each key where its hash points."""
    bits = max(4, (4 * len(keys)).bit_length())
    where = [((keys.view(np.uint64) * f) >> np.uint64(64 - bits)).tolist() for f in _FACTORS]
    slots: list[list[int]] = [[-1] * (1 << bits) for _ in _FACTORS]
    for k in range(len(keys)):
        side, item = 0, k
        for _ in range(500):
            at = where[side][item]
            item, slots[side][at] = slots[side][at], item
            if item < 0:
                break
            side = 1 - side
        else:
            raise ValueError("the pairs don't fit the tables")
    return bits, [np.maximum(np.array(s, np.int32), 0) for s in slots]


class _Codes(dict):
    """Numbers of words. A word that is looked up for the first time gets the next one and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class PieceModel:
    """The pairs that a model file's pieces can be merged from, by rank, and a cache of words."""

    def __init__(self, path: str = MODEL) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path.removeprefix("file://"), "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be BPE with byte fallback and without normalisation")
        self.prefix = spec.add_dummy_prefix
        all_pieces = list(proto.pieces)
        normal = {p.piece: k for k, p in enumerate(all_pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a space mark after another letter")
        self.byte_id = np.zeros(256, np.int32)
        for k, p in enumerate(all_pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = k
        #: Letters without a piece have symbols of their own, beyond the ids.
        self.beyond = len(all_pieces)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.beyond
        symbols = dict(normal)
        for c in {c for p in normal for c in p}:
            symbols.setdefault(c, self.beyond + ord(c))
            self.symbol[ord(c)] = symbols[c]
        ranks = {s: k for k, s in enumerate(sorted({all_pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = sorted((symbols[p[:k]] << _SHIFT | symbols[p[k:]], i, ranks[all_pieces[i].score]) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.made = np.array([*(p[1] for p in pairs), 0], np.int32)
        self.rank = np.array([*(p[2] for p in pairs), _NONE], np.int32)
        self.bits, self.slots = _cuckoo(self.keys)
        self.text: list[bytes] = []
        for p in all_pieces:
            self.text.append(bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else " ⁇ ".encode() if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode())
        self.marked = [p.type == _NORMAL and p.piece.startswith(MARK) for p in all_pieces]
        self.simple = self.prefix and self.symbol[10] >= self.beyond
        self.clear()

    def clear(self) -> None:
        self.code = _Codes()
        self.starts = np.zeros(1024, np.int64)
        self.sizes = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.used = 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the tables, the last place for pairs that can't be merged."""
        key = left.astype(np.int64) << _SHIFT | right
        none = len(self.keys)
        out = np.full(len(key), none, np.int32)
        for slots, factor in zip(self.slots, _FACTORS, strict=True):
            at = slots[(key.view(np.uint64) * factor) >> np.uint64(64 - self.bits)]
            hit = self.keys[at] == key
            out[hit] = at[hit]
        return out

    def _merge(self, symbols: np.ndarray, words: np.ndarray, pair: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols, words and pairs after the chosen merges, and the places whose pair these changed."""
        at = np.flatnonzero(chosen)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        out = symbols.copy()
        out[at] = self.made[pair[at]]
        out, words, pair = out[keep], words[keep], pair[keep]
        at = at - np.arange(len(at))
        near = np.zeros(len(out) + 1, bool)
        near[at] = near[at - 1] = True
        changed = np.flatnonzero(near[: len(out)])
        after = np.minimum(changed + 1, len(out) - 1)
        found = self._pairs(out[changed], out[after])
        pair[changed] = np.where((words[changed] == words[after]) & (after > changed), found, len(self.keys))
        return out, words, pair, changed

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after another, and the number of symbols of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        done_s, done_w = [], []
        none = len(self.keys)
        pair = np.full(len(symbols), none, np.int32)
        if len(symbols) > 1:
            pair[:-1] = np.where(word[:-1] == word[1:], self._pairs(symbols[:-1], symbols[1:]), none)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(word)])
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, counts)
            if (least == _NONE).any():
                going = best != _NONE
                done_s.append(symbols[~going])
                done_w.append(word[~going])
                symbols, word, pair, rank, best = symbols[going], word[going], pair[going], rank[going], best[going]
                if not len(symbols):
                    break
            hit = rank == best
            chosen = hit
            if (hit[1:] & hit[:-1]).any():
                # of adjacent hits every other one, from the leftmost, is merged
                place = np.arange(len(hit), dtype=np.int32)
                run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
                chosen = hit & ((place - run_start) & 1 == 0)
            new_s, new_w, new_pair, changed = self._merge(symbols, word, pair, chosen)
            new_first = np.flatnonzero(np.r_[True, new_w[1:] != new_w[:-1]])
            limit = np.repeat(least[least != _NONE], np.diff(np.r_[new_first, len(new_w)]))
            early = self.rank[new_pair[changed]] <= limit[changed]
            if early.any():
                again = np.isin(word, new_w[changed[early]])
                seen = np.cumsum(chosen)
                before = np.where(np.r_[True, word[1:] != word[:-1]], seen - chosen, 0)
                chosen = chosen & (~again | (seen - np.maximum.accumulate(before) == 1))
                new_s, new_w, new_pair, changed = self._merge(symbols, word, pair, chosen)
            symbols, word, pair = new_s, new_w, new_pair
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(words))

    def _as_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the bytes of the letters that have none."""
        odd = symbols >= self.beyond
        if not odd.any():
            return symbols.astype(np.int32), sizes
        code = np.where(odd, symbols - self.beyond, 0)
        n = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        word = np.repeat(np.arange(len(sizes)), sizes)
        out, ends = np.repeat(symbols, n), np.cumsum(n)
        k = np.arange(len(out)) - np.repeat(ends - n, n)
        code, n_of, odd_of = np.repeat(code, n), np.repeat(n, n), np.repeat(odd, n)
        part = code >> (6 * (n_of - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n_of]
        byte = np.where(k > 0, 0x80 | (part & 0x3F), lead | part)
        out[odd_of] = self.byte_id[byte[odd_of]]
        return out.astype(np.int32), np.bincount(word, n, minlength=len(sizes)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes words, as ``split`` names them, and keeps their ids."""
        ids, sizes = self._as_bytes(*self.merge_rounds([w if w[:1] == "\n" and w[1:2] != "\0" else w[2:] if w[:1] == "\n" else MARK + w for w in words]))
        n, k = len(self.code) - len(words), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + k > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + k] = sizes
        self.used += len(ids)

    def split(self, text: str) -> list[str]:
        """Names of the text's words. A name is a word without its one space mark; with a line break
        in front, which no piece holds, it is just that; and after a line break and a zero, it is any word as it stands."""
        if not text:
            return []
        if self.simple and MARK not in text and "  " not in text and text[0] != " " and "\0" not in text:
            first, *rest = text.split("\n")
            out = first.split(" ")
            for line in rest:
                parts = line.split(" ")
                parts[0] = "\n" + parts[0]
                out += parts
            return out
        return ["\n\0" + w for w in _RUNS.findall((MARK if self.prefix else "") + text.replace(" ", MARK))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and the last's end."""
        if len(self.code) > _CACHE_WORDS:
            self.clear()
        split = [self.split(t) if t else [] for t in texts]
        counts = np.cumsum([0, *map(len, split)])
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(split)), np.int64, counts[-1])
        if self.code.new:
            self._learn(self.code.new)
            self.code.new = []
        sizes, ends = self.sizes[codes], np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = np.repeat(self.starts[codes] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[at], ends[counts]

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        raw = b"".join([text[i] for i in ids.tolist()])
        if self.prefix and raw[:1] == b" " and self.marked[next(i for i in ids.tolist() if text[i])]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "gleaner-each-byte")


@lru_cache(maxsize=2)
def piece_model(path: str = MODEL) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``docs`` and the ids of each text: null for null, an empty list for an empty text. Whole
    texts are encoded; characters outside the vocabulary as their UTF-8 bytes. Columns stay as they are; a
    column that has the name ``ids_col`` is replaced. Repeated rows stay, each with the same ids; ties between merges fall to the
    leftmost; an empty table stays empty. A text stands in memory whole, with some arrays of its length."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = piece_model(model)
        hold(m)
        for column in texts:
            lists, step = [], 128
            for k in range(0, len(column), step):
                part = column.slice(k, step)
                ids, ends = m.encode(part.to_pylist())
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=part.is_null()))
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, encode(col(text_col).cast("string")))


def decode_pieces(docs: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` and the text of each list of ids: null for null, empty for an empty list. Bytes
    that aren't UTF-8 become one replacement character each; null ids are skipped, others outside the vocabulary are errors."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.StringType())
    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = piece_model(model)
        for column in lists:
            yield pa.array([m.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid and len(x.values.drop_null()) else "" if x.is_valid else None for x in column], pa.string())

    return docs.withColumn(text_col, decode(col(ids_col)))


def with_round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", same_col: str = "round_trip", model: str = MODEL) -> DataFrame:
    """Encodes and decodes in one pass: the ids of each text, and whether they decode to it. Both are null for null."""
    small_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])

    @F.arrow_udf(kind)
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = piece_model(model)
        hold(m)
        for column in texts:
            lists, same = [], []
            for k in range(0, len(column), 128):
                part = column.slice(k, 128)
                strings = part.to_pylist()
                ids, ends = m.encode(strings)
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=part.is_null()))
                same += [None if s is None else m.decode(ids[a:b]) == s for s, a, b in zip(strings, ends[:-1], ends[1:], strict=True)]
            yield pa.StructArray.from_arrays([pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["ids", "same"])

    made = docs.select("*", both(col(text_col).cast("string")).alias("gl_both"))
    return made.withColumns({ids_col: F.col("gl_both.ids"), same_col: F.col("gl_both.same")}).drop("gl_both")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, their number, and whether decoding them gives its text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_round_trip(docs).select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), "round_trip")
