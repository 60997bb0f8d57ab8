"""Recordings read by byte ranges: equal to reading them whole, in several tasks, of any size."""

import pickle
import struct

import numpy as np
import pytest
from pulsegrid.constants import HOP_SIZE, SAMPLE_RATE
from pulsegrid.functions.kernels import resample_rows
from pulsegrid.functions.polyphase import Polyphase
from pulsegrid.plans import extended
from pulsegrid.plans.transcribe import transcribe, transcribe_ranges
from pulsegrid.sources import ranges
from pulsegrid.sources import recordings as R

from test_transcribe import silence, tone

FRAMES = 64  # 32,768 samples a segment: short files have several


def wav(data, rate=SAMPLE_RATE, width=2, floating=False, extra=b"", riff=b"RIFF"):
    data = data if data.ndim == 2 else data[:, None]
    if floating:
        body = data.astype(f"<f{width}").tobytes()
    elif width == 1:
        body = (data * 127 + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(data * (2 ** (8 * width - 1) - 1)).astype("<i4")
        body = whole.astype(f"<i{width}").tobytes() if width != 3 else whole.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    channels = data.shape[1]
    form = struct.pack("<HHIIHH", 3 if floating else 1, channels, rate, rate * width * channels, width * channels, 8 * width)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + extra
    if riff == b"RF64":
        chunks = b"ds64" + struct.pack("<IQQQI", 28, 0, len(body), len(data), 0) + chunks + b"data" + struct.pack("<I", 0xFFFFFFFF)
    else:
        chunks += b"data" + struct.pack("<I", len(body))
    return riff + struct.pack("<I", 0xFFFFFFFF if riff == b"RF64" else 4 + len(chunks) + len(body)) + b"WAVE" + chunks + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("ranges")
    rng = np.random.default_rng(3)
    noise = rng.uniform(-0.9, 0.9, (200_000, 2))
    (d / "a").mkdir()
    (d / "a" / "stereo.wav").write_bytes(wav(noise, width=2))
    (d / "a" / "three.wav").write_bytes(wav(noise, width=3, extra=b"LIST" + struct.pack("<I", 5) + b"12345\0"))
    (d / "one.WAV").write_bytes(wav(noise[:, 0], width=1))
    (d / "float.wav").write_bytes(wav(noise[:150_000, 0], width=8, floating=True))
    (d / "rf64.wav").write_bytes(wav(noise[:, 0], width=4, riff=b"RF64"))
    (d / "plain.raw").write_bytes((noise[:, 0] * 32767).astype("<i2").tobytes() + b"\1")
    (d / "empty.wav").write_bytes(wav(noise[:0]))
    (d / "short.wav").write_bytes(wav(noise[:1000]))
    (d / "cut.wav").write_bytes(wav(noise)[:-7])
    (d / "nothing.wav").write_bytes(b"")
    (d / "song.mp3").write_bytes(b"ID3 and so on")
    (d / "notes.txt").write_text("no audio")
    (d / "_hidden.wav").write_bytes(wav(noise))
    return d


def rows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.recording_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.seg) for k, v in out.items()}


@pytest.mark.parametrize(("size", "highpass"), [(50_000, False), (30, False), (1 << 30, True), (77_777, True)])
def test_segments_equal_whole_decoding(spark, folder, size, highpass):
    if size == 30:  # ranges shorter than a header
        whole = rows(R.decode(R.scan(spark, str(folder), "short.wav"), frames=FRAMES))
        assert rows(ranges.scan_segments(spark, str(folder), pathGlobFilter="short.wav", rangeBytes=size, frames=FRAMES)) == whole
        return
    files = R.scan(spark, str(folder)).where("content_type is not null")
    whole = rows(R.decode(files, highpass=highpass, frames=FRAMES))
    parts = rows(ranges.scan_segments(spark, str(folder), rangeBytes=size, highpass=highpass, frames=FRAMES))
    # Spark's own readers pass over files without bytes.
    assert set(parts) - set(whole) == {f"file:{folder}/nothing.wav"} and len(whole) == 10
    for path, want in whole.items():
        got = parts[path]
        assert [(r.seg, r.lead, r.n_samples, r.original_sample_rate, r.channels, r.error) for r in got] == [
            (r.seg, r.lead, r.n_samples, r.original_sample_rate, r.channels, r.error) for r in want
        ]
        for a, b in zip(got, want):
            if a.error is None:
                np.testing.assert_allclose(a.samples, b.samples, atol=1e-7 if highpass else 0)
    assert sum(r[0].error is not None for r in parts.values()) == 3


def test_a_long_file_is_read_by_several_tasks(spark, folder):
    df = ranges.scan_segments(spark, str(folder), pathGlobFilter="three.wav", rangeBytes=100_000, frames=FRAMES)
    assert df.rdd.getNumPartitions() == 13
    tasks = df.selectExpr("spark_partition_id() as task", "seg").distinct().collect()
    assert len(tasks) == 7 and len({t.task for t in tasks}) == 7
    reader = ranges.RangeReader({"path": str(folder), "rangeBytes": str(1 << 30)})
    assert len(reader.partitions()) == 1 and len(reader.partitions()[0].ranges) == 11


def test_path_filters_choose_files(spark, folder):
    df = ranges.scan_segments(spark, str(folder), rangeBytes=100_000, frames=FRAMES)
    one = df.where(f"recording_id = 'file:{folder}/a/stereo.wav'")
    assert one.rdd.getNumPartitions() == 9 and one.select("recording_id").distinct().count() == 1
    assert df.where("recording_id like '%.raw'").rdd.getNumPartitions() == 5
    assert df.where("recording_id in ('x', 'y')").collect() == []
    assert df.where("seg = 1 and recording_id like '%.raw'").count() == 1


def test_without_pushed_filters(spark, folder):
    """A session in which filters are not pushed down reads the same; Spark filters the rows itself."""
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = ranges.scan_segments(spark, str(folder), rangeBytes=100_000, frames=FRAMES).where("recording_id like '%.raw'")
        assert df.count() == R.segment_count(200_000, FRAMES) and df.rdd.getNumPartitions() > 20
        direct = spark.read.format("recording_ranges").option("frames", FRAMES).load(str(folder))
        assert direct.where("recording_id like '%.raw'").count() == R.segment_count(200_000, FRAMES)
    finally:
        spark.conf.set(key, before)


def test_a_file_beyond_two_gibibytes(spark, tmp_path):
    """A sparse file of 2.2 GB: ranges read it; read whole, it goes to quarantine and the others are analysed."""
    (tmp_path / "small.wav").write_bytes(wav(np.concatenate([silence(0.25), tone(440, 0.5)])))
    header = wav(np.zeros((0, 8)), width=4)
    frames = 2_200_000_000 // 32
    header = header[:-4] + struct.pack("<I", frames * 32)
    click = np.zeros((4000, 8))
    click[:200] = 0.5
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(header)
        f.seek(len(header) + (frames - SAMPLE_RATE) * 32)
        f.write(np.round(click * (2**31 - 1)).astype("<i4").tobytes())
        f.truncate(len(header) + frames * 32)
    df = ranges.scan_segments(spark, str(tmp_path), pathGlobFilter="long.wav")
    assert df.rdd.getNumPartitions() == 33
    found = df.selectExpr("seg", "n_samples", "array_max(samples) > 0.4 as loud", "spark_partition_id() as task").collect()
    assert sorted(r.seg for r in found) == list(range(R.segment_count(frames, R.SEGMENT_FRAMES))) and len({r.task for r in found}) >= 30
    loud = {r.seg for r in found if r.loud}
    assert (frames - SAMPLE_RATE) // (R.SEGMENT_FRAMES * HOP_SIZE) in loud and len(loud) <= 2
    whole = transcribe(R.scan(spark, str(tmp_path)))
    assert [(r.recording_id.rsplit("/")[-1], r.error) for r in whole.quarantine.collect()] == [("long.wav", "File too large to read whole")]
    assert whole.summary.count() == 1


def test_transcription_by_ranges(spark, tmp_path):
    scale = np.concatenate([silence(0.25), *[tone(440 * 2 ** (m / 12), 0.5) for m in range(12)]])
    (tmp_path / "scale.wav").write_bytes(wav(scale))
    (tmp_path / "half.wav").write_bytes(wav(np.concatenate([silence(0.25, 22050), *[tone(440 * 2 ** (m / 12), 0.5, 22050) for m in (0, 4, 7)]]), rate=22050))
    (tmp_path / "text.txt").write_text("no audio")
    whole = transcribe(R.scan(spark, str(tmp_path)))
    parts = transcribe_ranges(spark, str(tmp_path), rangeBytes=100_000)
    half = f"file:{tmp_path}/half.wav"
    for name in ("onsets", "notes", "chords", "summary", "quarantine", "file_info"):
        a, b = (sorted((r for r in getattr(t, name).collect() if r.recording_id != half), key=str) for t in (whole, parts))
        assert a == b and (a or name == "chords"), name
    # Resampled otherwise, the three tones are found where they begin.
    begun = sorted(r.time_seconds for r in parts.onsets.collect() if r.recording_id == half)
    assert len(begun) == 3 and np.abs(np.array(begun) - [0.25, 0.75, 1.25]).max() < 0.06
    assert [r.midi_note % 12 for r in parts.notes.orderBy("frame_index").collect() if r.recording_id == half] == [9, 1, 4]


# Polyphase resampling


@pytest.mark.parametrize(("rate", "target"), [(48_000, 44_100), (22_050, 44_100), (96_000, 44_100), (8_000, 44_100), (44_099, 44_100)])
def test_polyphase_equals_the_whole_transform(rate, target):
    """Within 2e-6 of the Fourier method away from the ends, for tones below 0.9 of the lower Nyquist frequency."""
    n = rate  # one second: tones of whole hertz are periodic in it
    t = np.arange(n) / rate
    rng = np.random.default_rng(rate)
    top = int(0.9 * min(rate, target) / 2)
    x = sum(rng.uniform(0.05, 0.2) * np.sin(2 * np.pi * f * t + rng.uniform(0, 6)) for f in rng.integers(20, top, 8))
    bank = Polyphase(rate, target)
    whole = resample_rows(x[None, :], target)[0]
    inner = slice(target // 10, -target // 10)
    assert np.abs(bank.outputs(x, 0, 0, target) - whole)[inner].max() < 2e-6
    # Any run of outputs from its own inputs, in at least five segments.
    cuts = np.linspace(0, target, 7).astype(int)
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = bank.inputs(a, b)
        lo, hi = max(0, lo), min(n, hi)
        parts.append(bank.outputs(x[lo:hi], lo, a, b))
    np.testing.assert_allclose(np.concatenate(parts), bank.outputs(x, 0, 0, target), atol=1e-12)


def test_resampled_ranges_equal_the_whole_transform(spark, tmp_path):
    rate, n = 48_000, 300_000
    t = np.arange(n) / rate
    x = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 5000 * t) + 0.1 * np.sin(2 * np.pi * 17_000 * t)
    (tmp_path / "a.wav").write_bytes(wav(x, rate=rate, width=8, floating=True))
    parts = rows(ranges.scan_segments(spark, str(tmp_path), rangeBytes=200_000, frames=FRAMES))
    (got,) = parts.values()
    m = n * 147 // 160
    whole = resample_rows(x[None, :], m)[0]
    assert len(got) >= 5 and [r.seg for r in got] == list(range(len(got))) and all(r.n_samples == m for r in got)
    for r in got:
        first = (r.seg * FRAMES - r.lead) * HOP_SIZE
        span = np.arange(first, first + len(r.samples))
        inner = (span > 5000) & (span < m - 5000)
        assert np.abs(np.array(r.samples) - whole[span])[inner].max() < 1e-5
    refused = ranges.scan_segments(spark, str(tmp_path), resample=False).collect()
    assert [r.error for r in refused] == ["Expected 44100 Hz, got 48000"]


def test_files_are_written_whole(spark, tmp_path):
    df = spark.range(1, 21).selectExpr("concat('sub/', id, '.raw') as name", "encode(repeat('ab', cast(id * 100 as int)), 'UTF-8') as content").repartition(4)
    written = R.write_files(df, str(tmp_path / "out"))
    assert {r.name: r.length for r in written.collect()} == {f"sub/{i}.raw": 200 * i for i in range(1, 21)}
    written.collect()  # again: the same files
    found = R.listing(spark, str(tmp_path / "out"))
    assert found.count() == 20 and found.selectExpr("sum(length)").first()[0] == 200 * 210


# Many files


def plain_scan(texts):
    """(doc_id, n_samples, total, largest, smallest) of whole documents."""
    out = set()
    for doc_id, text in texts:
        raw = text.encode()
        x = np.frombuffer(raw + b"\0" * (len(raw) % 2), "<i2").astype(int)
        if len(x):
            out.add((doc_id, len(x), int(x.sum()), int(x.max()), int(x.min())))
    return out


def test_range_scan_names_no_documents_to_the_driver(spark, tmp_path, monkeypatch):
    """What the driver hands to tasks, and the fullest folder that it lists, stay small when documents are many."""
    rng = np.random.default_rng(5)
    texts = [(i, "same text" if i % 3 else "".join(chr(c) for c in rng.integers(32, 700, 1 + i % 97))) for i in range(2999)]
    texts += [(9000, "x" * 700_001), (9001, ""), (9002, "a")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = tmp_path / "audio"
    monkeypatch.setattr(extended, "own_folder", lambda *_: str(folder))
    assert {tuple(r) for r in extended.range_scan(spark, str(tmp_path)).collect()} == plain_scan(texts)
    files = [f for f in folder.rglob("*") if f.is_file()]
    assert len(files) == 3001
    assert max(sum(1 for _ in d.iterdir()) for d in [folder, *folder.iterdir()] if d.is_dir()) <= 1024
    reader = ranges.RangeReader({"path": str(folder), "listings": str(tmp_path / "listings"), "rangeBytes": "65536"})
    parts = reader.partitions()
    assert len(pickle.dumps(parts)) < 30_000
    assert sorted({r.path for p in parts for r in p.ranges}) == sorted(f"file:{f}" for f in files)


def test_listed_files_are_those_of_the_folder(spark, tmp_path, monkeypatch):
    """Ranges that stand in a listing are those that partitions name themselves, in the order of paths."""
    place = tmp_path / "in"
    for name in ("a.raw", "a/b.raw", "a-b.raw", "a/_c.raw", ".d/e.raw", "_f/g.raw", "a/h/i.raw", "j.wav", "k.txt", "a0.raw", "empty/l/m.RAW", "z/.n.raw"):
        (place / name).parent.mkdir(parents=True, exist_ok=True)
        (place / name).write_bytes(b"12" * 50)
    for i in range(300):
        (place / "z" / f"{i}.raw").write_bytes(b"1234" * i)
    (place / "z" / "long.raw").write_bytes(b"1234" * 60_000)
    (place / "nothing").mkdir()
    found = [*ranges.listed(str(place))]
    assert found == sorted(found) and len(found) == 309
    assert [p for p, _ in ranges.listed(str(place), "?.raw") if "/z/" not in p] == [f"file:{place}/{x}" for x in ("a.raw", "a/b.raw", "a/h/i.raw")]
    assert [*ranges.listed(str(place / "a.raw"))] == [(f"file:{place}/a.raw", 100)]
    with pytest.raises(FileNotFoundError):
        [*ranges.listed(str(place / "absent"))]
    monkeypatch.setattr(ranges, "FEW_FILES", 8)
    given = {"path": str(place), "rangeBytes": "50000"}
    named, short = (ranges.RangeReader(g).partitions() for g in (given, {**given, "listings": f"file://{tmp_path}/lists"}))
    assert [p.ranges for p in named] == [p.ranges for p in short]
    assert {type(p) for p in short} == {ranges.Ranges, ranges.ListedRanges} and sum(len(p.ranges) > 8 for p in named) > 3
    monkeypatch.setattr(ranges, "TASK_FILES", 20)
    few = ranges.RangeReader(given).partitions()
    assert max(len(p.ranges) for p in few) == 20 and {r for p in few for r in p.ranges} == {r for p in named for r in p.ranges}


def test_a_session_without_a_shared_folder_names_files(spark, folder, monkeypatch):
    whole = rows(ranges.scan_segments(spark, str(folder), pathGlobFilter="*.wav", frames=FRAMES))

    def refuse(_):
        raise ValueError("no shared folder")

    assert ranges._listings(spark).startswith("file:")
    for root in (refuse, lambda _: "nowhere://x/y", lambda _: "viewfs:/only/spark/reads"):
        monkeypatch.setattr(ranges, "stage_root", root)
        assert ranges._listings(spark) is None
        assert rows(ranges.scan_segments(spark, str(folder), pathGlobFilter="*.wav", frames=FRAMES)) == whole


def test_many_files_are_read_by_a_listing(spark, tmp_path):
    for i in range(2 * ranges.FEW_FILES):
        (tmp_path / f"{i}.raw").write_bytes(struct.pack("<3h", i, -i, 7))
    df = ranges.scan_segments(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    assert {(r.recording_id, tuple(int(x * 32768) for x in r.samples)) for r in df.collect()} == {
        (f"file:{tmp_path}/{i}.raw", (i, -i, 7)) for i in range(2 * ranges.FEW_FILES)
    }
