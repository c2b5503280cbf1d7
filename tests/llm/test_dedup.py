import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import line_dedup, simhash
from gleaner.llm.components import connected_components

_RNG = random.Random(0)
VOCABULARY = ["".join(_RNG.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in connected_components(edges).collect()} == {(x, find(x)) for x in root}
    assert connected_components(edges.limit(0)).count() == 0


def brute_groups(rows):
    """Groups of all pairs of fingerprints within the threshold, compared one by one."""
    made = simhash.Fingerprinter(simhash.WORDS)
    prints = [(i, made.one(t)) for i, t in rows]
    limit = int(simhash.MAX_SHARE * 63 * simhash.WORDS)
    near, root = set(), {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, p) in enumerate(prints):
        for j, q in prints[:k]:
            if p is not None and q is not None and int(np.bitwise_count((p ^ q).view(np.uint64)).sum()) <= limit:
                near.add((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return near, {i: find(i) for i, _ in prints}


def test_fingerprints_by_hand():
    import hashlib

    made = simhash.Fingerprinter(2)
    words = ["alphabet", "another", "thirdword"]
    votes = sum(len(w) * np.unpackbits(np.frombuffer(hashlib.shake_128(w.encode()).digest(16), np.uint8)).astype(int) for w in words + ["of"])
    bits = votes * 2 > 8 + 7 + 9 + 2
    bits[::64] = False
    assert (made.one("Alphabet, of another THIRDWORD alphabet") == np.packbits(bits).view(">i8")).all()
    assert made.one(None) is None and made.one(" \n") is None and (made.one("a bc") >= 0).all() and made.one("!!!") is not None
    long = " ".join(VOCABULARY) + " "
    assert (made.one(long * 60) == made.one(long)).all()


def test_groups_against_brute_force(spark, documents):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        base = prose(rng, rng.randint(60, 400))
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    near, groups = brute_groups(rows)
    prints = simhash.fingerprints(documents(rows)).withColumnRenamed("id", "rep")
    found = {(r["a"], r["b"]) for r in simhash.near_pairs(prints).collect()}
    assert found <= near and len(found) >= 0.95 * len(near)
    got = {r["id"]: r["group_id"] for r in simhash.near_duplicate_groups(documents(rows)).collect()}
    assert sum(got[i] == g for i, g in groups.items()) >= 0.97 * len(groups)


def test_pairs_closer_than_the_number_of_blocks_are_all_found(spark):
    rows = flipped(np.random.default_rng(2), [simhash.WORDS * simhash.PER_WORD - 1] * 100)
    prints = spark.createDataFrame(rows, PRINTS)
    assert {(r["a"], r["b"], r["distance"]) for r in simhash.near_pairs(prints).collect()} == {(2 * k, 2 * k + 1, simhash.WORDS * simhash.PER_WORD - 1) for k in range(100)}


def flipped(rng, distances):
    """Rows (rep, f0, ...) of pairs 2k and 2k + 1 that differ in so many random bits."""
    rows = []
    for k, d in enumerate(distances):
        bits = rng.integers(0, 2, 64 * simhash.WORDS).astype(bool)
        bits[::64] = False
        other = bits.copy()
        other[rng.choice(np.flatnonzero(np.arange(64 * simhash.WORDS) % 64), d, replace=False)] ^= True
        rows += [(2 * k + j, *np.packbits(b).view(">i8").astype(int).tolist()) for j, b in enumerate((bits, other))]
    return rows


PRINTS = "rep bigint, " + ", ".join(f"f{k} bigint" for k in range(simhash.WORDS))


def test_pairs_that_crowd_into_second_keys_are_found(spark):
    """41 bits, 19 of them in each of two longs and the rest one to a block, as badly placed as can be."""
    rng, rows = np.random.default_rng(13), []
    for k in range(60):
        one = rng.integers(0, 1 << 63, simhash.WORDS)
        two = one.copy()
        crowded = rng.choice(simhash.WORDS, 2, replace=False)
        for w in crowded:
            for bit in rng.choice(63, 19, replace=False):
                two[w] ^= 1 << int(bit)
        for w in rng.choice([w for w in range(simhash.WORDS) if w not in crowded], 3, replace=False):
            two[w] ^= 1 << int(rng.integers(63))
        rows += [(2 * k, *one.tolist()), (2 * k + 1, *two.tolist())]
    assert {(r["a"], r["b"], r["distance"]) for r in simhash.near_pairs(spark.createDataFrame(rows, PRINTS)).collect()} == {(2 * k, 2 * k + 1, 41) for k in range(60)}
    assert simhash.second_key_bits() == 18 and all(48 - d > 3 * (d // 19) for d in range(42))


def test_recall_by_distance_up_to_the_threshold(spark):
    most = int(simhash.MAX_SHARE * 63 * simhash.WORDS)
    bands = (60, 90, 120, 130, 140, most, most + 1)
    rows = flipped(np.random.default_rng(7), [d for d in bands for _ in range(300)])
    found = defaultdict(int)
    for r in simhash.near_pairs(spark.createDataFrame(rows, PRINTS)).collect():
        assert (r["a"] ^ 1) == r["b"] and r["distance"] == bands[r["a"] // 600]
        found[r["distance"]] += 1
    assert found[most + 1] == 0 and all(found[d] >= 0.9 * 300 for d in bands[:-1]) and found[60] == found[90] == 300


def test_every_bit_is_in_one_block_of_either_cut(spark):
    rows = [(bit, *[1 << (bit % 63) if k == bit // 63 else 0 for k in range(simhash.WORDS)]) for bit in range(63 * simhash.WORDS)]
    keys = spark.createDataFrame(rows, PRINTS).select(F.array(*simhash.block_keys()).alias("k")).collect()
    at = [[n for n, v in enumerate(r["k"]) if v & ((1 << 21) - 1)] for r in keys]
    assert all(len(x) == 2 and x[0] < 48 <= x[1] for x in at) and {v >> 21 for r in keys for v in r["k"]} == set(range(96))


def test_a_hot_block_is_compared_tile_by_tile(spark):
    """Two hundred rows that share every block but one, in tiles of seven, give all their pairs."""
    rng = np.random.default_rng(9)
    rows = [(k, *[int(rng.integers(0, 1 << 9)) if j == 3 else j for j in range(simhash.WORDS)]) for k in range(200)]
    far = [(1000 + k, *rng.integers(0, 1 << 63, simhash.WORDS).tolist()) for k in range(50)]
    got = simhash.near_pairs(spark.createDataFrame(rows + far, PRINTS), tile=7).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for b in range(200) for a in range(b)}


def test_links_are_counted(spark, documents):
    rng = random.Random(12)
    base = prose(rng, 200)
    near = [" ".join([*base[:k], "otherword", *base[k + 1 :]]) for k in (3, 90)]
    rows = [(1, " ".join(base)), (2, near[0]), (3, near[1]), (4, near[1]), (5, " ".join(prose(rng, 100))), (6, None)]
    got = {r["id"]: (r["group_id"], r["keep"], r["n_links"]) for r in simhash.near_duplicate_groups(documents(rows)).collect()}
    assert got == {1: (1, True, 2), 2: (1, False, 2), 3: (1, False, 2), 4: (1, False, 2), 5: (5, True, 0), 6: (6, True, 0)}
    assert simhash.near_duplicate_groups(documents(rows).limit(0)).count() == 0


def test_one_of_each_group_stays(spark, documents):
    rng = random.Random(3)
    base, other = " ".join(prose(rng, 200)), " ".join(prose(rng, 200))
    near = " ".join(edited(rng, base.split(), 0.01))
    rows = [(5, base), (2, base), (9, near), (7, other), (7, other), (3, None), (4, ""), (6, " "), (None, base), (8, other + " end"), (8, base), (3, None)]
    got = simhash.drop_near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got) == [-1, 2, 3, 3, 4, 6, 7]
    assert got[0]["th"] == "keep me" and got[0]["id"] == 7 and set(got[0].asDict()) == set(documents(rows).columns)
    groups = simhash.near_duplicate_groups(documents(rows)).collect()
    assert len(groups) == len(rows)
    assert simhash.drop_near_duplicates(documents(rows).limit(0)).count() == 0
    assert simhash.drop_near_duplicates(documents([(1, "word " * 400_000), (2, "other")])).count() == 2


def test_near_copies_are_judged_by_their_originals(spark, documents):
    """What line dedup leaves of a near copy resembles nothing, and goes all the same."""
    rng = random.Random(14)
    lines = [" ".join(prose(rng, 12)) for _ in range(20)]
    near = [" ".join(edited(rng, x.split(), 0.1)) if k % 4 == 0 else x for k, x in enumerate(lines)]
    whole = [(1, "\n".join(lines)), (2, "\n".join(near)), (3, " ".join(prose(rng, 90))), (4, "\n".join(near)), (None, "\n".join(lines)), (5, "toxic"), (6, "a"), (6, "b")]
    cut = [(1, "\n".join(lines)), (2, "\n".join(near[::4])), (3, whole[2][1]), (None, whole[0][1]), (6, "a"), (6, "b")]
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(documents(cut)).collect()} == {1, 2, 3, None, 6}
    got = simhash.drop_near_duplicates(documents(cut), originals=documents(whole)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3, 6, 6] and got[0].asDict().keys() == set(documents(cut).columns)
    alone = simhash.drop_near_duplicates(documents(cut[1:3]), originals=documents(whole)).collect()
    assert {r["doc_id"] for r in alone} == {2, 3}


def test_many_copies(spark, documents):
    rng = random.Random(4)
    base = prose(rng, 150)
    rows = [(k, " ".join(base if k % 2 else edited(rng, base, 0.01))) for k in range(400)] + [(1000 + k, " ".join(prose(rng, 100))) for k in range(20)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(documents(rows)).collect()}
    assert kept == {0} | {1000 + k for k in range(20)}


def brute_lines(rows, min_chars=line_dedup.MIN_CHARS):
    """Every document against the owners of its lines, by the definition."""
    held = defaultdict(lambda: defaultdict(list))
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = " ".join(line.split())
            if len(line) >= min_chars:
                held[i][line].append(k)
    owner = {}
    for i in sorted(held):
        for line in held[i]:
            owner.setdefault(line, i)
    out = {}
    for i, text in rows:
        gone = set()
        for e in {owner[x] for x in held[i]} - {i}:
            mine = sorted((k, x) for x, at in held[i].items() if owner[x] == e for k in at)
            other = sorted((k, x) for x, at in held[e].items() if x in held[i] and owner[x] == e for k in at)
            gone |= {mine[a][0] for a, _ in line_dedup.patience([x for _, x in mine], [x for _, x in other])}
        out[i] = text if text is None or not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_aligns_in_order():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))
        assert len(found) <= longest_common(a, b)
        c = rng.sample(range(50), 12)
        d = [x for x in c if rng.random() < 0.7] + [99]
        assert len(line_dedup.patience(c, d)) == longest_common(c, d) == len(d) - 1
    assert line_dedup.patience(list(range(50_000)), list(range(50_000))) == [(k, k) for k in range(50_000)]


def test_lines_against_brute_force(spark, documents):
    rng = random.Random(6)
    pool = [" ".join(prose(rng, rng.randint(3, 9))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else " ".join(prose(rng, 5)) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(10)] + [(300, "\n".join(reversed(rows[3][1].split("\n"))))]
    expected = brute_lines(rows)
    rng.shuffle(rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert got == expected
    assert all(got[200 + k] == "" for k in range(10))


def test_few_lines_are_missed_against_all_pairs(spark, documents):
    """Every later document against every earlier one would delete hardly more."""
    rng = random.Random(8)
    pool = [[" ".join(prose(rng, 6)) for _ in range(rng.randint(1, 5))] for _ in range(30)]
    rows = []
    for i in range(100):
        parts = [[" ".join(prose(rng, 6)) for _ in range(3)]] + [rng.choice(pool) for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    lines = {i: t.split("\n") for i, t in rows}
    everything = {(i, a) for i in lines for j in range(i) for a, _ in line_dedup.patience(lines[i], lines[j])}
    lost = sum(r["n"] for r in line_dedup.dedup_lines(documents(rows), deleted_col="n").collect())
    assert lost >= 0.9 * len(everything)


def test_lines_with_nulls_ties_and_long_texts(spark, documents):
    line, second = "a line that is long enough to count", "and a second one that also counts"
    rows = [(1, line), (2, f"{line}\nown words that stand only here"), (3, None), (3, ""), (None, line), (4, f"short\n{line}  \nshort"), (5, "short\nshort"), (2, f"{line}\nown words that stand only here"), (6, f"{line}\n{second}"), (6, f"{second}\nx"), (7, "y" * 2_000_000 + "\n" + line)]
    got = sorted(((r["doc_id"] or 0, r["text"] or ""), r["n"], r["th"]) for r in line_dedup.dedup_lines(documents(rows), deleted_col="n").collect())
    texts = [t for t, _, _ in got]
    assert len(got) == len(rows) and {h for _, _, h in got} == {"keep me"}
    assert (1, line) in texts and (0, line) in texts and texts.count((2, "own words that stand only here")) == 2
    assert (4, "short\nshort") in texts and (5, "short\nshort") in texts and (7, "y" * 2_000_000) in texts
    assert sum(second in t for i, t in texts if i == 6) == 1
    assert line_dedup.dedup_lines(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("min_chars", [1, 60])
def test_length_of_lines_is_a_parameter(spark, documents, min_chars):
    rows = [(1, "tiny"), (2, "tiny\nb")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(rows), min_chars=min_chars).collect()}
    assert got[2] == ("b" if min_chars == 1 else "tiny\nb")


def test_the_list_of_a_documents_long_words_is_no_copy(spark, documents):
    rng = random.Random(6)
    words = [w for x in prose(rng, 300) for w in (x, rng.choice(["of", "the", "a", "in"]))]
    near = [*words[:100], *prose(rng, 3), *words[103:]]
    rows = [(1, " ".join(words)), (2, " | ".join(dict.fromkeys(w for w in words if len(w) >= 5))), (3, " ".join(near)), (4, " ".join(words[::-1]))]
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(documents(rows)).collect()} == {1, 2, 4}
    made = simhash.Sketcher()
    assert made.one(None) is None and made.one(" ") is None and made.one("!!!") != made.one("???") and made.one("a b") == made.one("A, b")
    assert simhash.similarity([made.one("a b c " * 50)], [made.one("a b c " * 2)])[0] < 0.2


def test_no_pair_up_to_the_threshold_is_missed(spark):
    most = int(simhash.MAX_SHARE * 63 * simhash.WORDS)
    rows = flipped(np.random.default_rng(21), [most] * 300 + [most + 1] * 20)
    found = {(r["a"], r["b"], r["distance"]) for r in simhash.near_pairs(spark.createDataFrame(rows, PRINTS), tile=200).collect()}
    assert found == {(2 * k, 2 * k + 1, most) for k in range(300)}


def test_sketches_at_the_threshold_share_a_key():
    """As few equal lanes as count, the others filled in both sketches or in one."""
    rng, levels = np.random.default_rng(22), simhash.key_levels()

    def keys(v):
        mine = [(low, i, j) for low, high, i, j in levels if (v > 0).sum() <= high and (v > 0).sum() / low >= simhash.MIN_SIMILARITY]
        return {(low, a, b, v[a], v[b]) for low, i, j in mine for a, b in zip(i, j, strict=True) if v[a] and v[b]}

    for filled in range(1, simhash.LANES + 1):
        equal = next(e for e in range(1, filled + 1) if e / filled >= simhash.MIN_SIMILARITY)
        for share in (0.0, 0.3, 1.0):
            a, b, lanes = np.zeros(simhash.LANES, int), np.zeros(simhash.LANES, int), rng.permutation(simhash.LANES)[:filled]
            a[lanes], b[lanes] = rng.integers(1, 1 << 14, filled), rng.integers(1 << 14, 1 << 15, filled)
            a[lanes[:equal]] = b[lanes[:equal]]
            only = rng.random(filled) < share
            only[:equal] = False
            b[lanes[only]] = 0
            assert keys(a) & keys(b)


def test_links_against_all_pairs(spark, documents):
    """Pairs up to the threshold, short texts and many versions of one text, by key and in crowds: each text's links are counted in full."""
    rng, rows = random.Random(23), []
    for n in (2, 4, 7, 12, 30, 60, 120, 250):
        base = prose(rng, n)
        rows += [" ".join(edited(rng, base, share)) for share in (0, 0.03, 0.07, 0.1, 0.12, 0.15)]
    base = prose(rng, 150)
    rows += [" ".join(edited(rng, base, 0.06)) for _ in range(90)]
    rows = list(enumerate(dict.fromkeys(rows)))
    prints = simhash.fingerprints(documents(rows)).withColumnRenamed("id", "rep").cache()
    sketch = {r["rep"]: bytes(r["sketch"]) for r in prints.collect()}
    expected = defaultdict(int)
    for a, b in brute_groups(rows)[0]:
        if simhash.similarity([sketch[a]], [sketch[b]])[0] >= simhash.MIN_SIMILARITY:
            expected[a] += 1
            expected[b] += 1
    for crowd in (10, 1000):
        links = simhash.near_links(prints, tile=32, crowd=crowd).groupBy("a").agg(F.sum("n").alias("n")).collect()
        assert {r["a"]: r["n"] for r in links} == expected


def shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_versions_of_a_text_that_others_share_keys_with_are_written_once(spark):
    """Two hundred versions of one text, of which ten each share a key with three hundred other texts: pairs of versions share a hundred keys and more."""
    rng, words = np.random.default_rng(31), simhash.WORDS
    base, print_ = rng.integers(1, 1 << 15, simhash.LANES), rng.integers(0, 1 << 63, words)
    sketches = np.where(rng.random((2600, simhash.LANES)) < 0.9, base, rng.integers(1, 1 << 15, (2600, simhash.LANES)))
    sketches[200:] = rng.integers(1, 1 << 15, (2400, simhash.LANES))
    _, _, i, j = simhash.key_levels()[-1]
    for k in range(8):
        for lane in (i[10 * k], j[10 * k]):
            sketches[200 + 300 * k : 500 + 300 * k, lane] = sketches[10 * k : 10 * k + 10, lane] = rng.integers(1, 1 << 15)
    rows = [(k, *(print_ if k < 200 else rng.integers(0, 1 << 63, words)).tolist(), s.astype("<u2").tobytes()) for k, s in enumerate(sketches)]
    equal = (sketches[:200, None] == sketches[None, :200]).sum(axis=2)
    confs = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        made = shuffled(spark)
        got = simhash.near_links(spark.createDataFrame(rows, PRINTS + ", sketch binary")).groupBy("a").agg(F.sum("n").alias("n")).collect()
        made = shuffled(spark) - made
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    linked = equal / simhash.LANES >= simhash.MIN_SIMILARITY
    assert {r["a"]: r["n"] for r in got} == {a: linked[a].sum() - 1 for a in range(200)} and linked.sum() > 30_000
    assert made < 900_000, made


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time
    from pathlib import Path

    from gleaner.llm.common import written

    folders = [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for d in folders for p in d.rglob("shuffle_*.data")}
    there, until = files(), time.time() + 5
    written(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count(), "test")
    while files() - there and time.time() < until:
        time.sleep(0.1)
    assert not files() - there


def test_fingerprint_and_sketch_of_one_look_at_the_words_are_those_of_two(spark):
    rng, made = random.Random(32), simhash.Fingerprinter(simhash.WORDS)
    texts = [None, "", " ", "!!!", "a", "A, b a", "word " * 40_000, " ".join(VOCABULARY * 20), *[" ".join(prose(rng, n)) for n in (1, 3, 200, 2500, 15_000)], " ".join(f"w{k}" for k in range(20_000))]
    for t in texts * 3 + [" ".join(f"{t}x{k}" for k in range(12_000)) for t in range(15)]:
        print_, sketch = made.both(t, simhash.Sketcher())
        other = simhash.Fingerprinter(simhash.WORDS).one(t)
        assert sketch == simhash.Sketcher().one(t) and (other is None) == (print_ is None) and (print_ is None or (print_ == other).all())
