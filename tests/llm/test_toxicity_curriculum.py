import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import curriculum, toxicity

BAD = ["vilewordone", "vilewordtwo", "nastything", "awfulterm"]
_RNG = random.Random(0)
GOOD = ["".join(_RNG.choice("abcdefghij") for _ in range(6)) for _ in range(400)]


def corpus(n, seed, noise=0.0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(40, 300))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if rng.random() >= noise else int(not bad)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents(spark, documents):
    rows, labels = corpus(1200, 1, noise=0.03)
    held_out, truth = corpus(400, 2)
    model = toxicity.fit_severity(documents(rows), table(spark, labels))
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    scored = {r["doc_id"]: r["severity"] for r in toxicity.with_severity(documents(held_out), model).collect()}
    right = sum(scored[i]["rejected"] == bool(y) for i, y in truth)
    assert right >= 0.99 * len(truth)
    for s in scored.values():
        assert 0 <= s["expected"] <= 2 and s["grade"] in (0, 1, 2)
    kept = toxicity.drop_toxic(documents(rows), table(spark, labels))
    assert set(kept.columns) == set(documents(rows).columns)


def test_grades_share_one_order():
    """Planted thresholds on one line come back, and severity rises with the score."""
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 4, 3000)
    grades = (x + rng.logistic(0, 0.1, 3000) > 1).astype(int) + (x + rng.logistic(0, 0.1, 3000) > 3)
    rows, cols = np.arange(3000), np.zeros(3000, int)
    w, cuts = toxicity.fit_cumulative_link(rows, cols, x, grades, 1, l2=0, steps=2000)
    assert cuts[0] / w[0] == pytest.approx(1, abs=0.1) and cuts[1] / w[0] == pytest.approx(3, abs=0.1)
    p = toxicity.OrdinalModel({}, cuts.tolist()).probabilities(np.linspace(-5, 60, 200))
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and (np.diff(p @ [0, 1, 2]) >= -1e-12).all()


def test_gradient_of_the_fit():
    """One more grade than cuts, and a fit that no small step improves."""
    rng = np.random.default_rng(1)
    rows, cols, values = np.repeat(np.arange(200), 3), rng.integers(0, 5, 600), rng.random(600)
    grades = rng.integers(0, 3, 200)

    def loss(w, cuts):
        p = toxicity.OrdinalModel({}, list(cuts)).probabilities(np.bincount(rows, values * w[cols], minlength=200))
        return -np.log(p[np.arange(200), grades]).mean()

    w, cuts = toxicity.fit_cumulative_link(rows, cols, values, grades, 5, l2=0, steps=3000)
    for k in range(5):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(5) == k), cuts) >= loss(w, cuts) - 1e-6


def test_graded_labels(spark, documents):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        g = rng.choice([0, 0, 1, 2, 3])
        words = [rng.choice(GOOD) for _ in range(100)]
        for k in range(4 * g):
            words[k * 7] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, g))
    model = toxicity.fit_severity(documents(rows), table(spark, labels), graded=True)
    assert len(model.cuts) == 3 and sorted(model.cuts) == model.cuts
    got = {r["doc_id"]: r["severity"] for r in toxicity.with_severity(documents(rows), model).collect()}
    assert sum(got[i]["grade"] == g for i, g in labels) >= 0.95 * len(labels)


def test_fit_and_scores_against_plain_python(spark, documents):
    """Features, their selection, grades and scores, one document and one word at a time."""
    import math

    rows, labels = corpus(250, 9)
    flag = dict(labels)
    held = {}
    for i, text in rows:
        words = text.lower().split()
        counts = {}
        for w in words:
            for f in [w, *[w[:n] + "*" for n in toxicity.PREFIXES if len(w) >= n]]:
                counts[f] = counts.get(f, 0) + 100 / len(words)
        held[i] = counts

    def ratio(f):
        total = 0.0
        for on in (0, 1):
            for has in (False, True):
                n = sum((f in held[i]) == has and flag[i] == on for i in held)
                if n:
                    total += 2 * n * math.log(n * len(held) / (sum(flag[i] == on for i in held) * sum((f in held[i]) == has for i in held)))
        return total

    docs_with = {}
    for c in held.values():
        for f in c:
            docs_with[f] = docs_with.get(f, 0) + 1
    chosen = {f for f, n in docs_with.items() if n >= toxicity.MIN_DOCS and ratio(f) >= toxicity.MIN_RATIO}
    model = toxicity.fit_severity(documents(rows), table(spark, labels))
    assert set(model.weights) == chosen and len(chosen) >= 4
    n1 = sum(flag.values())
    often = {f for f in chosen if (sum(f in held[i] for i in held if flag[i]) + 0.5) / (n1 + 1) >= 8 * (sum(f in held[i] for i in held if not flag[i]) + 0.5) / (len(held) - n1 + 1)}
    rate = {i: sum(v for f, v in c.items() if f in often) for i, c in held.items()}
    middle = np.median([v for i, v in rate.items() if flag[i] and v > 0])
    grades = {i: 0 if not flag[i] else 2 if rate[i] > middle else 1 for i in held}
    score = {i: sum(v * model.weights.get(f, 0.0) for f, v in c.items()) for i, c in held.items()}
    got = {r["doc_id"]: r["severity"] for r in toxicity.with_severity(documents(rows), model).collect()}
    right = 0
    for i in held:
        below = [1 / (1 + math.exp(score[i] - c)) for c in model.cuts]
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert got[i]["expected"] == pytest.approx(p[1] + 2 * p[2], abs=1e-6) and got[i]["grade"] == p.index(max(p)) and got[i]["rejected"] == (1 - p[0] >= toxicity.REJECT)
        right += got[i]["grade"] == grades[i]
    assert right >= 0.9 * len(held)


def test_toxicity_edges(spark, documents):
    rows, labels = corpus(300, 4)
    model = toxicity.fit_severity(documents(rows), table(spark, labels))
    odd = documents([(1, None), (2, ""), (3, "!!! ..."), (4, " ".join(BAD)), (4, " ".join(BAD)), (5, ("goodword " * 50 + BAD[0] + " ") * 30_000)])
    got = toxicity.with_severity(odd, model, name="th").collect()
    assert len(got) == 6
    flags = {r["doc_id"]: r["th"]["rejected"] for r in got if r["doc_id"] in (1, 2, 3, 4)}
    assert flags == {1: False, 2: False, 3: False, 4: True}
    for bad in (table(spark, labels).limit(0), table(spark, [(i, 0) for i, _ in labels]), table(spark, [(None, 1), (1, None)])):
        nothing = toxicity.fit_severity(documents(rows), bad)
        assert toxicity.with_severity(odd, nothing).where("severity.rejected or severity.expected <> 0").count() == 0
    assert toxicity.with_severity(documents(rows).limit(0), model).count() == 0
    twice = table(spark, labels + labels)
    assert toxicity.fit_severity(documents(rows), twice).cuts == pytest.approx(model.cuts)


def walk(rows, schedule, budget=None, max_epochs=50):
    """Positions by numeric integration and bisection, source by source."""
    tokens = lambda t: len(t.split()) if t else 0
    sources = sorted({s for _, _, s in rows})
    supply = {s: sum(tokens(t) for _, t, x in rows if x == s) for s in sources}
    budget = budget or sum(supply.values())
    weight = lambda s, u: np.interp(u, *zip(*schedule.get(s, schedule.get("*", [(0, 0)]))))
    grid = np.linspace(0, 1, 40_001)
    times = np.array(sorted({0, 1} | {t for s in sources for t, _ in schedule.get(s, schedule.get("*", []))}))
    total = sum(weight(s, times) for s in sources)
    out = {}
    for s in sources:
        w = np.interp(grid, times, weight(s, times) / np.maximum(total, 1e-300))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))]) * budget
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, t, x in rows if x == s)
        for e in range(max_epochs):
            run = e * supply[s]
            for _, i, t in mine:
                c = run + tokens(t) / 2
                run += tokens(t)
                if c <= demand[-1] * (1 + 1e-9) and demand[-1] > 0 and (e == 0 or tokens(t)):
                    out[i, e] = float(np.interp(c, demand, grid))
    return out, budget


def test_small_sources_meet_their_targets(spark, documents):
    """No use of a document is the last but the one that meets the weight; a bound's shortfall is reported."""
    rows = [(k, "w " * 10, "big") for k in range(90)] + [(100 + k, "w " * 10, "small") for k in range(3)]
    schedule = {"big": [(0, 1), (1, 1)], "small": [(0, 1), (1, 1)]}
    got = curriculum.mix(documents(rows), schedule).collect()
    tokens = {s: sum(10 for r in got if r["source"] == s) for s in ("big", "small")}
    assert abs(tokens["small"] - 465) <= 10 and abs(tokens["big"] - 465) <= 10 and max(r["epoch"] for r in got) == 15
    lack = {r["source"]: r["unmet"] for r in curriculum.shortfall(documents(rows), schedule, max_epochs=4).collect()}
    assert lack == {"big": 0.0, "small": 345.0}
    assert sum(r["source"] == "small" for r in curriculum.mix(documents(rows), schedule, max_epochs=4).collect()) == 12
    with pytest.raises(ValueError, match="too small"):
        curriculum.mix(documents([*[(k, "w " * 9000, "big") for k in range(9)], (99, "w", "small")]), schedule)


def mixed_rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["src0", "src0", "src0", "src1", "src2", "src3"])) for i in range(n)]


def test_positions_against_integration(spark, documents):
    rows = mixed_rows(1)
    expected, _ = walk(rows, curriculum.SCHEDULE)
    got = curriculum.mix(documents(rows), buckets=16).collect()
    assert {(r["doc_id"], r["epoch"]) for r in got} == set(expected)
    for r in got:
        assert r["position"] == pytest.approx(expected[r["doc_id"], r["epoch"]], abs=1e-3)
    places = [r["position"] for r in got]
    assert places == sorted(places)


def test_windows_hold_the_scheduled_weights(spark, documents):
    rows = mixed_rows(2, 3000)
    schedule = {"*": [(0, 1), (1, 1)], "src0": [(0, 3), (1, 0)], "src3": [(0, 0), (1, 3)]}
    got = curriculum.mix(documents(rows), schedule, buckets=16).collect()
    size = {i: len(t.split()) for i, t, _ in rows}
    for low in (0, 0.25, 0.5, 0.75):
        inside = [r for r in got if low <= r["position"] < low + 0.25]
        total = sum(size[r["doc_id"]] for r in inside)
        mid = low + 0.125
        weights = {"src0": 3 - 3 * mid, "src1": 1, "src2": 1, "src3": 3 * mid}
        for s, w in weights.items():
            assert sum(size[r["doc_id"]] for r in inside if r["source"] == s) / total == pytest.approx(w / sum(weights.values()), abs=0.03)


def test_natural_schedule_uses_everything_once(spark, documents):
    rows = mixed_rows(3)
    rows = [(i, t or "w", s) for i, t, s in rows]
    got = curriculum.mix(documents(rows), None).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _ in rows] and {r["epoch"] for r in got} == {0}


def test_curriculum_edges(spark, documents):
    rows = [(1, "a b c", None), (2, None, "src0"), (3, "", "src0"), (4, "x " * 500_000, "src0"), (5, "same", "src1"), (5, "same", "src1"), (None, "no id", "src1"), (6, "z", "gone")]
    docs = documents(rows)
    got = curriculum.mix(docs, {"*": [(0, 1), (1, 1)], "gone": [(0, 0)]}, max_epochs=1, position="th", epoch="id").collect()
    assert "gone" not in {r["source"] for r in got} and all(0 <= r["th"] <= 1 for r in got)
    assert sorted(r["doc_id"] or 0 for r in curriculum.mix(docs, None).collect()) == [0, 1, 2, 3, 4, 5, 5, 6]
    assert curriculum.mix(docs.limit(0), None).count() == 0 and curriculum.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        curriculum.mix(docs, {"*": [(0, -1), (1, 1)]})
