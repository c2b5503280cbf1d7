"""URL filter: a weighted vocabulary of strict and soft terms, found by one Aho-Corasick pass.

URLs are read in small letters, with escapes of ASCII (``%63asino``) undone once.
A term counts where neither neighbour is a letter a-z or a digit. One strict term rejects a URL;
soft terms do so together, when ``MIN_SOFT`` different ones weigh ``MIN_WEIGHT`` or more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import col

#: Term, whether one occurrence rejects, and its weight as a soft term.
Vocabulary = Sequence[tuple[str, bool, float]]
VOCABULARY: Vocabulary = [
    *((t, True, 1.0) for t in "casino casinos porn porno pornhub xxx sexcam sexcams hentai viagra cialis malware phishing ransomware warez escort escorts camgirls torrentz keygens serialz milf bdsm nudity onlinecasino pokies slotmachine botnet carding fullz darkweb".split()),
    *((t, False, 1.0) for t in "adult spam pills bets betting gambling poker nude nudes lottery jackpot payday crack cracked keygen torrent torrents sex sexy dating pharmacy replica steroids hacked piracy spyware clickbait ponzi".split()),
    *((t, False, 0.5) for t in "free win winner cheap ads adserver track tracker farm x bonus click deal deals hot loan loans credit promo offer offers prize popup redirect download mirror proxy forex crypto bitcoin rich".split()),
]
MIN_SOFT = 2
#: Two soft terms of weight 1, one of them and one of 0.5, or three of 0.5.
MIN_WEIGHT = 1.5
_ESCAPE = re.compile("%([0-7][0-9a-f])")
_INSIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
KIND = T.StructType([T.StructField("strict", T.IntegerType()), T.StructField("soft", T.IntegerType()), T.StructField("soft_weight", T.DoubleType()), T.StructField("hits", T.IntegerType()), T.StructField("rejected", T.BooleanType())])


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    """Of the lowercased terms. A term that stands twice is an error, as is an empty one."""
    made = ahocorasick.Automaton()
    for term, strict, weight in vocabulary:
        term = term.lower()
        if not term or term in made:
            raise ValueError(f"the term {term!r} is empty or stands twice")
        made.add_word(term, (term, strict, weight))
    made.make_automaton()
    return made


def judge(url: str, found: ahocorasick.Automaton, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT) -> tuple[int, int, float, int, bool]:
    """Different strict terms, different soft terms, the weight of these, all occurrences, verdict."""
    url = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), url.lower()).lower()
    strict, soft, hits = set(), {}, 0
    for end, (term, hard, weight) in found.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _INSIDE) and (end + 1 == len(url) or url[end + 1] not in _INSIDE):
            hits += 1
            if hard:
                strict.add(term)
            else:
                soft[term] = weight
    total = float(sum(soft.values()))
    return len(strict), len(soft), total, hits, bool(strict) or (len(soft) >= min_soft and total >= min_weight)


def vocabulary_of(table: DataFrame) -> Vocabulary:
    """The vocabulary of a table ``(term, strict, weight)``, which is as small as a setting: it is collected and sent with the
    function. Null terms are left out, a null flag is false, a null weight 1."""
    rows = table.where("term is not null").select("term", F.coalesce("strict", F.lit(False)).alias("s"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("w")).collect()
    return [(r["term"], r["s"], r["w"]) for r in rows]


def with_url_verdict(rows: DataFrame, url_col: str = "url", name: str = "verdict", vocabulary: Vocabulary = VOCABULARY, min_soft: int = MIN_SOFT, min_weight: float = MIN_WEIGHT) -> DataFrame:
    """``rows`` and a struct of counts and the verdict. A null or empty URL has no hits and is not
    rejected; a long URL is read whole; repeated rows and any other columns stay, and an empty table stays empty. A column that has the name ``name`` is replaced.

    Only the URL goes through Python. An empty vocabulary finds nothing."""

    @F.arrow_udf(KIND)
    def verdict(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = automaton(vocabulary) if vocabulary else None
        for column in urls:
            out = [judge(u, found, min_soft, min_weight) if u and found is not None else (0, 0, 0.0, 0, False) for u in column.to_pylist()]
            parts = [[row[k] for row in out] for k in range(len(KIND))]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names=KIND.names)

    return rows.withColumn(name, verdict(col(url_col).cast("string")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the URL of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return with_url_verdict(pages).select("page_id", "url", "verdict.*")


def _unescaped(url: str) -> str:
    """SQL of a URL without escapes: of letters first, then all but digits, then digits, so that none is undone twice."""
    for c in "abcdefghijklmnopqrstuvwxyz":
        url = f"replace(replace({url}, '%{ord(c):x}', '{c}'), '%{ord(c.upper()):x}', '{c}')"
    url = f"regexp_replace({url}, '%([012456][0-9a-f]|3[a-f]|7[b-f])', ' ', 'g')"
    for c in "0123456789":
        url = f"replace({url}, '%{ord(c):x}', '{c}')"
    return url


OP7_SQL = f"""
WITH v(term, strict, weight) AS (VALUES {", ".join(f"('{t}', {str(s).upper()}, {w}::DOUBLE)" for t, s, w in VOCABULARY)}),
p AS (SELECT *, '  ' || regexp_replace({_unescaped("lower(coalesce(url, ''))")}, '[^a-z0-9]', '  ', 'g') || '  ' AS u,
  row_number() OVER () AS n FROM pages),
h AS (SELECT p.n, v.*, (length(u) - length(replace(u, ' ' || term || ' ', ''))) // (length(term) + 2) AS hits FROM p, v
  WHERE contains(u, ' ' || term || ' ')),
s AS (SELECT n, CAST(count(*) FILTER (strict) AS INTEGER) AS strict, CAST(count(*) FILTER (NOT strict) AS INTEGER) AS soft,
  coalesce(sum(weight) FILTER (NOT strict), 0) AS soft_weight, CAST(sum(hits) AS INTEGER) AS hits FROM h GROUP BY n)
SELECT page_id, url, coalesce(strict, 0) AS strict, coalesce(soft, 0) AS soft, coalesce(soft_weight, 0.0) AS soft_weight,
  coalesce(hits, 0) AS hits, coalesce(strict > 0 OR (soft >= {MIN_SOFT} AND soft_weight >= {MIN_WEIGHT}), FALSE) AS rejected
FROM p LEFT JOIN s USING (n)
"""
