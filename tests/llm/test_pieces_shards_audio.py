import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gleaner.llm import audio, pieces, token_shards

WORDS = ["", " ", "  ", "a  b", " lead", "trail ", "▁a▁▁b", "é☃漢字\n\t x", "a\nb \n c", "aaaaaaaaaaaa" * 5, "ab" * 40, "\x00\x01", "\U0001f600 hi", "nbsp nbsp", "\n\n\n", "<s> </s> <unk> <0x0A>"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel()


@pytest.fixture(scope="module")
def plain():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_those_of_the_library(model, plain):
    rng = random.Random(7)
    texts = WORDS + ["".join(rng.choice("theinraotsxé \n") for _ in range(rng.randint(1, 300))) for _ in range(800)] + ["".join(rng.choice("ab") for _ in range(4000)), "thein" * 20_000]
    ids, ends = model.encode(texts)
    for k, text in enumerate(texts):
        mine = ids[ends[k] : ends[k + 1]]
        assert mine.tolist() == plain.encode(text), text[:80]
        assert model.decode(mine) == plain.decode(mine.tolist())


def test_a_small_cache_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE_WORDS", 10)
    model = pieces.PieceModel()
    for text in ("the quick brown fox " * 10, "over\nlazy dogs", "one two three four five six seven eight nine ten eleven twelve"):
        assert model.encode([text, None])[0].tolist() == plain.encode(text)


def test_bytes_that_are_no_text(model, plain):
    for ids in ([0], [1, 2], [3 + 0xE2, 3 + 0x98, 13], [3 + 0x20], [3 + 0xFF, 500]):
        assert model.decode(np.array(ids)) == plain.decode(ids)


def test_encode_and_decode_tables(spark):
    rows = spark.createDataFrame([(1, "hello  world\n", "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 50_000, "x"), (1, "hello  world\n", "x")], "doc_id int, text string, gl_ids string")
    got = pieces.decode_pieces(pieces.encode_pieces(rows)).collect()
    assert all(r["decoded"] == r["text"] for r in got)
    assert [r["token_ids"] for r in got if r["doc_id"] in (2, 3)] == [None, []] and {r["gl_ids"] for r in got} == {"x"}
    trip = pieces.with_round_trip(rows).collect()
    assert [r["round_trip"] for r in trip] == [True, None, True, True, True] and [r["token_ids"] for r in trip] == [r["token_ids"] for r in got]
    assert pieces.encode_pieces(rows.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9], list(range(3000)), [0, 1 << 40], sorted(random.Random(1).randrange(1 << 33) for _ in range(5000)), [k * 1000 for k in range(2000)]])
def test_elias_fano(values):
    code = token_shards.EliasFano.from_bytes(token_shards.EliasFano.of(np.array(values)).to_bytes())
    assert [code.select(i) for i in range(len(values))] == values
    assert code.span(0, len(values)).tolist() == values
    rng = random.Random(2)
    for _ in range(20):
        a, b = sorted((rng.randint(0, len(values)), rng.randint(0, len(values))))
        assert code.span(a, b).tolist() == values[a:b]


def test_elias_fano_is_small_and_strict():
    values = np.cumsum(np.random.default_rng(0).integers(0, 1400, 100_000))
    bits = 8 * len(token_shards.EliasFano.of(values).to_bytes()) / len(values)
    assert bits < 2 + np.log2(values[-1] / len(values)) + 0.4
    with pytest.raises(ValueError):
        token_shards.EliasFano.of(np.array([2, 1]))
    with pytest.raises(IndexError):
        token_shards.EliasFano.of(np.array([2])).select(1)
    assert token_shards.EliasFano.of(np.zeros(0, np.int64)).n == 0


@pytest.mark.parametrize("vocabulary", [32_000, 100_000])
def test_shards_give_every_document_back(spark, tmp_path, vocabulary):
    import xxhash

    lists = [[5, 6], [], None, [31_999] * 1000, list(range(700)), [5, 6]]
    rows = spark.createDataFrame([(k if k != 1 else None, ids, "s") for k, ids in enumerate(lists)], "doc_id bigint, token_ids array<int>, shard string").coalesce(1)
    shards = token_shards.write_token_shards(rows, f"file://{tmp_path}/s", vocabulary=vocabulary, shard_tokens=900)
    assert shards.agg(F.sum("n_docs"), F.sum("n_tokens")).first() == (6, 1704) and shards.count() == 2
    width = "<u2" if vocabulary == 32_000 else "<u4"
    got = token_shards.read_token_shards(shards).orderBy("shard", "ordinal").collect()
    assert [r["doc_id"] for r in got] == [0, None, 2, 3, 4, 5]
    assert [r["ids_xxh64"] for r in got] == [xxhash.xxh64_hexdigest(np.array(ids or [], width).tobytes()) for ids in lists]
    offset = {}
    for r, ids in zip(got, lists, strict=True):
        assert (r["start"], r["stop"]) == (offset.get(r["shard"], 0), offset.get(r["shard"], 0) + len(ids or []))
        offset[r["shard"]] = r["stop"]
    assert token_shards.write_token_shards(rows.limit(0), f"file://{tmp_path}/e").count() == 0
    with pytest.raises(Exception, match="not below"):
        token_shards.write_token_shards(rows, f"file://{tmp_path}/f", vocabulary=600)


def slow_resample(x, rate_in, rate_out):
    """The windowed sinc at each output's own time, sample by sample."""
    cut = min(1.0, rate_out / rate_in)
    out = []
    for n in range(-(-len(x) * rate_out // rate_in)):
        t = np.arange(-200, len(x) + 200) - n * rate_in / rate_out
        taps = cut * np.sinc(cut * t) * np.where(np.abs(t) * cut < audio.ZEROS, np.cos(np.pi * t * cut / (2 * audio.ZEROS)) ** 2, 0)
        out.append(float((np.pad(x, 200) * taps).sum() / taps.sum()))
    return np.array(out)


def sampled(x, rates=(audio.RATE_IN, audio.RATE)):
    clip = audio.Clip(x.astype("<i2").tobytes(), *rates)
    return clip, clip.samples(0, clip.n)


@pytest.mark.parametrize("rates", [(22_050, 16_000), (8_000, 16_000), (44_100, 16_000), (16_000, 16_000)])
def test_polyphase_is_the_windowed_sinc(rates):
    x = np.random.default_rng(3).integers(-9000, 9000, 700)
    level = (x - x.mean()) / 32768
    clip, got = sampled(x, rates)
    assert np.allclose(got, level if rates[0] == rates[1] else slow_resample(level, *rates), atol=1e-12)
    again = audio.Clip(x.astype("<i2").tobytes(), *rates)
    parts = [again.samples(k, min(k + 37, clip.n)) for k in range(0, clip.n, 37)]
    again.held = (0, 0, np.zeros(0))
    assert np.allclose(np.concatenate(parts), got, atol=1e-15) and np.allclose(again.samples(clip.n - 40, clip.n), got[-40:], atol=1e-15)


def test_a_tone_stays_where_it_is():
    t = np.arange(22_050) / 22_050
    clip, _ = sampled(20_000 * np.sin(2 * np.pi * 1000 * t))
    mel = audio.log_mel(clip.frames(0, clip.n_frames))
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), audio.MELS + 2) / 2595) - 1)
    peak = int(np.median(mel[5:-5].argmax(1)))
    assert edge[peak] < 1000 < edge[peak + 2]


def slow_tensors(pcm):
    """A clip's tensors by a sinc per sample, a discrete Fourier sum per frame and a state machine."""
    x = np.frombuffer(pcm, "<i2", len(pcm) // 2).astype(float)
    if not len(x):
        return []
    y = slow_resample((x - x.mean()) / 32768, audio.RATE_IN, audio.RATE)
    n = max(1, -(-(len(y) - 400) // 160) + 1)
    frames = [np.pad(y, (0, n * 160 + 400))[k * 160 : k * 160 + 400] for k in range(n)]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(400)) / 512)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), 66) / 2595) - 1)
    bands = [[max(0, min((f - a) / (b - a), (c - f) / (c - b))) for f in np.arange(257) * 16_000 / 512] for a, b, c in zip(edge, edge[1:], edge[2:])]
    mel = [np.log(np.maximum(np.array(bands) @ np.abs(wave @ (f * hann)) ** 2, 1e-10)) for f in frames]
    db = [10 * np.log10(max((f**2).mean(), 1e-12)) for f in frames]
    found, on = [], False
    for k, v in enumerate(db if max(db) > -100 else []):
        if not on and v >= max(db) - 12:
            on, start = True, k
        elif on and v < max(db) - 18:
            on = False
            found.append((start, k))
    found += [(start, n)] * on
    return [(s, p, k * 0.01, min(len(y) / 16_000, (k + min(16, b - k) - 1) * 0.01 + 0.025), min(16, b - k), np.array(mel[k : min(k + 16, b)])) for s, (a, b) in enumerate(found) for p, k in enumerate(range(a, b, 16))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_query_against_brute_force(spark):
    got = {(r["page_id"], r["segment"], r["part"]): r for r in audio.op4_audio_features(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    expected = {(p["page_id"], s, k): rest for p in pages for s, k, *rest in slow_tensors((p["html"] or "").encode())}
    assert set(got) == set(expected) and len(got) > len(pages) / 2
    for key, (start, end, n, mel) in expected.items():
        r = got[key]
        assert r["n_frames"] == n and (r["start_s"], r["end_s"]) == pytest.approx((start, end), abs=1e-9)
        tensor = np.array(r["log_mel"]).reshape(audio.FRAMES, audio.MELS)
        assert np.allclose(tensor[:n], mel, atol=1e-4) and not tensor[n:].any()


def test_a_long_clip_takes_no_more_memory(spark):
    """Twenty minutes in blocks: beside its bytes about as much as a minute takes."""
    import tracemalloc

    t = np.arange(22_050 * 60)
    minute = (8000 * np.sin(t / 7) * (t % 400_000 < 250_000)).astype("<i2").tobytes()
    peaks = []
    for pcm in (minute, minute * 20):
        tracemalloc.start()
        n = sum(1 for _ in audio.clip_tensors(pcm))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n > 150 * len(pcm) // len(minute)
    assert peaks[1] < peaks[0] + 20e6 and peaks[1] < 150e6


def test_hysteresis_segments():
    def slow(db, high, low):
        top, on, out = max(db), False, []
        for k, v in enumerate(db):
            if not on and v - top >= high:
                on, start = True, k
            elif on and v - top < low:
                on = False
                out.append((start, k))
        return out + [(start, len(db))] * on

    rng = np.random.default_rng(5)
    for _ in range(200):
        db = rng.uniform(-40, 0, rng.integers(1, 60))
        assert audio.segments(db, -10, -20) == slow(db.tolist(), -10, -20)
    assert audio.segments(np.full(5, -120.0)) == [] and audio.segments(np.zeros(0)) == []


def test_audio_tables_and_tensors(spark, tmp_path):
    t = np.arange(22_050)
    tone = (np.sin(t / 9) * 20_000 * ((t < 8000) | (t > 14_000))).astype("<i2").tobytes()
    rows = [(1, tone), (2, None), (3, b""), (4, b"\x01"), (5, b"\x00" * 4000), (None, tone), (1, tone), (6, tone * 40)]
    clips = spark.createDataFrame([(i, None if p is None else bytearray(p), "x") for i, p in rows], "page_id int, pcm binary, segment string")
    got = audio.audio_features(clips, "page_id", "pcm").collect()
    assert {r["id"] for r in got} == {1, None, 6}
    one = list(audio.clip_tensors(tone))
    mine = [r for r in got if r["id"] is None]
    assert len(mine) == len(one) and {r["segment"] for r in mine} == {0, 1}
    for r, (s, p, a, b, n, tensor) in zip(mine, one, strict=True):
        assert (r["segment"], r["part"], r["start_s"], r["end_s"], r["n_frames"]) == (s, p, a, b, n)
        assert np.allclose(r["log_mel"], tensor.reshape(-1), atol=1e-5) and not tensor[n:].any()
    assert one[0][2] == 0 and one[-1][3] == pytest.approx(1.0, abs=0.01)
    features = audio.audio_features(clips, "page_id", "pcm")
    tensors = audio.as_tensors(features.toArrow().column("log_mel"))
    assert tensors.type.shape == [audio.FRAMES, audio.MELS] and tensors.to_numpy_ndarray().shape[1:] == (audio.FRAMES, audio.MELS)
    files = audio.write_tensors(features, f"file://{tmp_path}/t").collect()
    assert sum(f["n_tensors"] for f in files) == len(got)
    back = audio.read_tensors(audio.write_tensors(features, f"file://{tmp_path}/u"), features.schema)
    row = lambda r: (r["id"] or 0, r["segment"], r["part"], r["start_s"], r["n_frames"], tuple(r["log_mel"]))
    assert back.schema == features.schema and sorted(map(row, back.collect())) == sorted(map(row, got))
    assert audio.read_tensors(audio.write_tensors(features.limit(0), f"file://{tmp_path}/v"), features.schema).count() == 0
    with pa.memory_map(files[0]["path"].removeprefix("file://")) as f:
        assert isinstance(pa.ipc.open_file(f).schema.field("log_mel").type, pa.FixedShapeTensorType)
    assert audio.audio_features(clips.limit(0), "page_id", "pcm").count() == 0
