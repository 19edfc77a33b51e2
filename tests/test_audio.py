import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtab.operators import audio as AU
from voxtab.sources.artifacts import list_artifacts
from voxtab.sources.audio import read_wav
from voxtab.sources.transcripts import write_transcripts


def write_wav(path, samples, rate=8000, channels=1, width=2):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        out.writeframes(samples.tobytes())


@pytest.fixture
def folder(tmp_path):
    t = np.arange(20000)
    write_wav(tmp_path / "mono.wav", (6000 * np.sin(t / 9)).astype("<i2"))
    stereo = np.stack([t % 50, -(t % 31)], axis=1).astype("<i2")
    write_wav(tmp_path / "stereo.WAV", stereo, rate=16000, channels=2)
    write_wav(tmp_path / "silence.wav", np.zeros(9000, "<i2"))
    peaks = np.full(16000, 100, "<i2")
    peaks[::400] = -30000
    write_wav(tmp_path / "peaks.wav", peaks)
    write_wav(tmp_path / "bytes.wav", (128 + t % 90).astype(np.uint8), width=1)
    write_wav(tmp_path / "wide.wav", t24(t), width=3)
    (tmp_path / "note.txt").write_text("no audio")
    return tmp_path


def t24(t):
    values = (t - 10000) * 700
    return np.stack([values & 255, (values >> 8) & 255, (values >> 16) & 255], axis=1).astype(np.uint8)


def pcm(folder):
    t = np.arange(20000)
    return {
        "mono": (6000 * np.sin(t / 9)).astype("<i2").astype(float),
        "stereo": np.stack([t % 50, -(t % 31)], axis=1).ravel().astype(float),
        "silence": np.zeros(9000),
        "peaks": np.where(np.arange(16000) % 400 == 0, -30000.0, 100.0),
        "bytes": (t % 90) * 256.0,
        "wide": (((t - 10000) * 700).astype(np.int32) / 256).astype(np.float32),
    }


def test_wav_frames(spark, folder):
    rows = read_wav(spark, str(folder)).orderBy("guid", "seq").collect()
    want = pcm(folder)
    for guid, samples in want.items():
        mine = [r for r in rows if r.guid == guid]
        assert [r.seq for r in mine] == list(range(len(mine)))
        assert np.array_equal(np.concatenate([r.samples for r in mine]), samples)
        assert all(len(r.samples) <= r.sample_rate * r.channels for r in mine)
    assert {r.guid for r in rows} == set(want)


def test_unreadable_files(spark, folder):
    (folder / "broken.wav").write_bytes(b"RIFF....")
    (folder / "empty.wav").write_bytes(b"")
    rows = read_wav(spark, str(folder), mode="PERMISSIVE")
    assert {r.guid for r in rows.where("error is not null").collect()} == {"broken"}
    assert rows.where("error is null").select("guid").distinct().count() == len(pcm(folder))
    assert AU.loudness(rows).count() == len(pcm(folder))
    with pytest.raises(Exception, match="broken|wave|RIFF|EOF|Error"):
        read_wav(spark, str(folder)).count()


def test_loudness_and_noise(spark, folder):
    frames = read_wav(spark, str(folder))
    got = {r.guid: r for r in AU.needs_denoise(AU.noise_energy(frames)).collect()}
    for guid, x in pcm(folder).items():
        rms = np.sqrt(np.mean(x**2))
        gain = -20 - 20 * np.log10(rms / 32768) if rms else 0.0
        scaled = np.clip(x * 10 ** (gain / 20), -32768, 32768)
        energy = np.mean(np.abs(scaled)) / 32768
        row = got[guid]
        assert row.gain_db == pytest.approx(gain)
        assert row.noise_energy == pytest.approx(energy), guid
        assert row.needs_denoise == (energy > 0.015)
    assert got["silence"].dbfs is None and not got["silence"].needs_denoise
    assert got["peaks"].peak * got["peaks"].factor > 32768
    assert got["mono"].duration_sec == 2.5 and got["stereo"].duration_sec == 1.25


def test_normalized_samples(spark, folder):
    frames = read_wav(spark, str(folder)).where(F.col("guid") == "peaks")
    rows = AU.normalize_gain(frames, AU.loudness(frames)).orderBy("seq").collect()
    x = pcm(folder)["peaks"]
    factor = 10 ** ((-20 - 20 * np.log10(np.sqrt(np.mean(x**2)) / 32768)) / 20)
    got = np.concatenate([r.samples for r in rows])
    assert np.allclose(got, np.clip(x * factor, -32768, 32768), rtol=1e-6)


def test_artifacts(spark, tmp_path):
    for name in ("a.mp3", "a_processed.mp3", "b.wav", "c_processed.mp3", "d.ogg", "a.txt", "e"):
        (tmp_path / name).write_bytes(b"x")
    listing = list_artifacts(spark, str(tmp_path))
    assert {(r.guid, r.kind) for r in listing.collect()} == {
        ("a", "original"), ("a", "processed"), ("a", "transcript"), ("b", "original"), ("c", "processed"),
        ("d", "original"), ("e", "original"),
    }
    jobs = spark.createDataFrame(
        [("a", "x.mp3"), ("b", "my.talk.wav"), ("c", "x.mp3"), ("d", "x.mp3"), ("e", "plain")], "guid string, filename string"
    )
    resolved = AU.resolve_audio(jobs, listing)
    got = {r.guid: (r.audio_found, r.audio_path) for r in resolved.collect()}
    assert got == {
        "a": (True, "a_processed.mp3"), "b": (True, "b.wav"), "c": (False, None), "d": (False, None), "e": (True, "e"),
    }
    assert {r.guid for r in AU.missing_audio(resolved).collect()} == {"c", "d"}


def test_transcript_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "one line"), ("b", "zwei é")], "guid string, transcript string")
    write_transcripts(df, str(tmp_path / "p"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", "one line"), ("b", "zwei é")}
    write_transcripts(df, str(tmp_path / "t"), layout="text")
    files = list((tmp_path / "t" / "guid=b").glob("*.txt"))
    assert [f.read_text().strip() for f in files] == ["zwei é"]
    with pytest.raises(ValueError):
        write_transcripts(df, str(tmp_path / "x"), layout="odd")
