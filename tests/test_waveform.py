"""The waveform engine: containers, codecs, conversion, metadata, streaming."""

import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wavequarry.functions import adpcm, samples, spec
from wavequarry.operators import metadata, waveform
from wavequarry.plans import catalogue, files  # noqa: F401  files adds its queries
from wavequarry.sources import codecs, flac, riff, wav
from wavequarry.streaming.codecs import yamaha_decode_stream

SF = "/root/testdata/sf0.001"
A = [0, 100, 500, 1000, -1000, -32768, 32767, 5]
PCM = ["u8", "i16", "i24", "i32", "i64", "f32", "f64"]


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in "nation customer part orders lineitem events documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v) for v in row))
    return sorted(out, key=repr)


def test_transcode_loss_of_all_codecs(spark):
    snr = {r["codec"]: r["snr_db"] for r in catalogue.transcode_loss(spark, SF).collect()}
    assert sorted(snr) == ["alaw", "flac", "ima", "ms", "mulaw", "yamaha"]
    assert snr["flac"] > 60 and snr["ima"] > 5


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, views, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalogue.ORACLE_SQL:
        want = views.execute(catalogue.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# ---- codecs ----


def test_golden_adpcm():
    frames = [[x] for x in A]
    assert adpcm.encode_ima(frames, 1).hex() == "000000007077ff97"
    assert [f[0] for f in adpcm.decode_ima(bytes.fromhex("000000007077ff97"), 1, 512)] == [0, 0, 13, 43, 106, -30, -324, 307, 36]
    assert adpcm.encode_ms(frames, 1)[:10].hex() == "0010006400000077887e"
    assert adpcm.nibbles_of(adpcm.encode_yamaha(frames, 1)) == [0, 2, 7, 7, 15, 15, 7, 9]
    codec = adpcm.Yamaha()
    assert [codec.expand(n) for n in range(16)] == [15, 62, 141, 252, 394, 603, 996, 1903, 1758, 1368, 783, 48, -800, -2043, -4389, -9804]


def test_folds_are_the_plain_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-32768, 32768, 200).tolist()
    n = rng.integers(0, 16, 200).tolist()
    row = spark.createDataFrame([(x, n)], "x array<int>, n array<int>").select(
        adpcm.ima_encode(F.col("x")), adpcm.ima_decode(F.col("n")), adpcm.ms_encode(F.col("x"), predictor=5), adpcm.ms_decode(F.col("n"), predictor=1), adpcm.yamaha_encode(F.col("x")), adpcm.yamaha_decode(F.col("n"))
    ).first()
    states = [adpcm.Ima(), adpcm.Ima(), adpcm.Ms(5), adpcm.Ms(1), adpcm.Yamaha(), adpcm.Yamaha()]
    for k, (s, got) in enumerate(zip(states, row, strict=True)):
        assert got == [s.expand(v) if k % 2 else s.compress(v) for v in (n if k % 2 else x)]


def test_length_laws():
    sine = (10000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)).astype(np.int64)[:, None]
    for codec, size, frames in (("ima", 4032, 8064 - 64 + 8), ("ms", 4096, 8144)):
        h = riff.from_bytes(raw := codecs.encode_file(sine, "i16", codec, 8000))
        assert h.data.size == size
        data = raw[h.data.offset : h.data.offset + size]
        assert len(codecs.decode(codec, data, h.fmt, "i16")) == codecs.total_frames(codec, h.fmt, size) == frames


@pytest.mark.parametrize("codec", PCM)
@pytest.mark.parametrize("channels", [1, 2, 6])
def test_pcm_is_lossless(codec, channels):
    rng = np.random.default_rng(2)
    if codec[0] == "f":
        x = rng.normal(size=(50, channels)).astype(codecs._DTYPES[codec])
    else:
        low, high = codecs._range(codec)
        x = rng.integers(low, high, (50, channels), endpoint=True)
    raw = codecs.encode_file(x, codec, codec, 44100, channel_mask=0x3F if channels == 6 else 0)
    h = riff.from_bytes(raw)
    assert riff.sample_kind(h.fmt) == codec
    assert (codecs.decode(codec, raw[h.data.offset : h.data.offset + h.data.size], h.fmt, codec) == x).all()


@pytest.mark.parametrize("codec,floor", [("alaw", 30), ("mulaw", 30), ("ima", 20), ("ms", 20), ("yamaha", 15)])
@pytest.mark.parametrize("channels", [1, 2])
def test_lossy_codecs(codec, floor, channels):
    t = np.arange(4000)[:, None] + np.arange(channels) * 7
    x = (10000 * np.sin(2 * np.pi * 440 * t / 8000)).astype(np.int64)
    raw = codecs.encode_file(x, "i16", codec, 8000)
    h = riff.from_bytes(raw)
    got = codecs.decode(codec, raw[h.data.offset : h.data.offset + h.data.size], h.fmt, "i16").astype(float)
    if codec == "ima":  # each block gives its header's sample first
        got = np.concatenate([got[k + 1 : k + 1017] for k in range(0, len(got), 1017)])
    noise = ((got[: len(x)] - x) ** 2).sum()
    assert 10 * np.log10((x.astype(float) ** 2).sum() / noise) > floor


def test_g711_in_both_forms(spark):
    x = list(range(-32768, 32768, 7))
    df = spark.createDataFrame([(x, list(range(256)))], "x array<int>, c array<int>")
    row = df.select(F.transform("x", samples.mulaw_encode), F.transform("x", samples.alaw_encode), F.transform("c", samples.mulaw_decode), F.transform("c", samples.alaw_decode)).first()
    assert row[0] == codecs.mulaw_codes(np.array(x)).tolist() and row[1] == codecs.alaw_codes(np.array(x)).tolist()
    assert row[2] == codecs.MULAW.tolist() and row[3] == codecs.ALAW.tolist()
    assert codecs.alaw_codes(codecs.ALAW).tolist() == list(range(256))


def test_scale_matches_numpy(spark):
    ints = {"i8": [-128, -1, 0, 5, 127], "u8": [0, 127, 128, 255], "i16": [-32768, -5, 0, 32767], "u16": [0, 32768, 65535], "i24": [-(2**23), 9, 2**23 - 1], "u24": [0, 2**24 - 1], "i32": [-(2**31), 7, 2**31 - 1], "u32": [0, 2**32 - 1], "i64": [-(2**63), 3, 2**63 - 1]}
    for source, values in ints.items():
        df = spark.createDataFrame([(v,) for v in values], f"v {samples.SPARK_TYPES[source]}")
        for target in [*ints, "f64"]:
            got = [r[0] for r in df.select(samples.scale(F.col("v"), source, target)).collect()]
            dtype = np.uint64 if source == "u64" else np.int64
            assert [float(g) for g in got] == [float(g) for g in codecs.convert(np.array(values, dtype), source, target).tolist()], (source, target)
    df = spark.createDataFrame([(v,) for v in [-2.0, -1.0, -0.3, 0.0, 0.7, 1.0, 9.0]], "v double")
    for target in ints:
        got = [int(r[0]) for r in df.select(samples.scale(F.col("v"), "f64", target)).collect()]
        assert got == codecs.convert(np.array([-2.0, -1.0, -0.3, 0.0, 0.7, 1.0, 9.0]), "f64", target).tolist(), target


@pytest.mark.parametrize("channels", [1, 2, 5])
@pytest.mark.parametrize("bits", [8, 16, 24])
def test_flac(channels, bits):
    rng = np.random.default_rng(bits)
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    tone = (np.sin(np.arange(5000) / 20)[:, None] * high * 0.5).astype(np.int64) + rng.integers(-3, 4, (5000, channels))
    for x in (tone, rng.integers(low, high, (4097, channels), endpoint=True), np.full((10, channels), low), np.array([[high] * channels]), np.zeros((0, channels), np.int64)):
        raw = flac.encode(x, 44100, bits)
        got, info = flac.decode(raw)
        assert (got == x).all() and got.shape == x.shape and info["rate"] == 44100 and info["frames"] == len(x)
    assert len(flac.encode(tone, 44100, bits)) < tone.size * bits // 8
    raw = flac.encode(tone, 44100, bits)
    with pytest.raises(ValueError):
        flac.decode(raw[:-40] + bytes([raw[-40] ^ 1]) + raw[-39:])
    assert [flac._number(n) for n in (0, 127, 128, 2047, 2048, 65535, 65536)] == [chr(n).encode() for n in (0, 127, 128, 2047, 2048)] + [b"\xef\xbf\xbf", chr(65536).encode()]
    h = riff.from_bytes(file := codecs.encode_file(x := tone, "i8" if bits == 8 else f"i{bits}", "flac", 8000, bits=bits))
    assert (codecs.decode("flac", file[h.data.offset : h.data.offset + h.data.size], h.fmt, f"i{bits}") == x).all()


def test_unavailable_codec():
    with pytest.raises(codecs.CodecUnavailable):
        codecs.decode("mp3", b"", {}, "f32")
    with pytest.raises(ValueError, match="channels"):
        codecs.encode_file(np.zeros((1, 3)), "f32", "mulaw", 8000)


# ---- containers ----

META = {
    "slnt": 7, "bext": {"description": "d", "originator": "o", "originator_ref": "r", "origination_date": "2024-01-02", "origination_time": "03:04:05", "time_ref": 2**40, "version": 1, "umid": b"u" * 64},
    "inst": dict(zip(["base_note", "detune", "gain", "low_note", "high_note", "low_velocity", "high_velocity"], range(7), strict=True)),
    "smpl": {"manufacturer": 1, "product": 2, "sample_period": 3, "midi_unity_note": 60, "midi_pitch_fraction": 0, "smpte_format": 0, "smpte_offset": 0, "sampler_data": 0, "loops": [dict(zip(["identifier", "type", "start", "end", "fraction", "play_count"], range(6), strict=True))]},
    "acid": {"flags": 1, "root_node": 60, "num_beats": 4, "meter_denominator": 4, "meter_numerator": 3, "tempo": 120.5}, "trkn": {"track_no": 3, "total_tracks": 9},
    "cues": [{"cue_point_id": 1, "position": 5, "data_chunk_id": "data", "chunk_start": 0, "block_start": 0, "offset": 5}, {"cue_point_id": 2, "position": 8, "data_chunk_id": "data", "chunk_start": 0, "block_start": 0, "offset": 8}],
    "plst": [{"cue_point_id": 1, "num_samples": 10, "repeats": 2}],
    "adtl": [{"kind": "labl", "cue_point_id": 1, "data": "one"}, {"kind": "note", "cue_point_id": 1, "data": "a note"}, {"kind": "ltxt", "cue_point_id": 2, "sample_length": 4, "purpose_id": "rgn", "country": 33, "language": 12, "dialect": 1, "code_page": 0, "data": "texte"}],
    "info": {"IART": "me", "ILNG": "fr", "itrk": "4"}, "axml": "<a/>", "ixml": "<i/>", "id3": b"ID3x", "junk": [b"xyz"],
}


@pytest.mark.parametrize("mode", ["never", "allow", "force"])
def test_metadata_round_trip(mode):
    raw = codecs.encode_file(np.zeros((3, 1)), "f32", "u8", 8000, meta=META, riff_mode=mode)
    h = riff.from_bytes(raw)
    assert h.container == ("RF64" if mode == "force" else "RIFF") and not h.corrupt and h.data.size == 3
    for name, want in META.items():
        if name == "info":
            assert h.meta["info"] == want | {"ITRK": "4"}
        elif name == "adtl":
            assert [(r["kind"], r["cue_point_id"], r["data"]) for r in h.meta["adtl"]] == [(r["kind"], r["cue_point_id"], r["data"]) for r in want]
        else:
            assert h.meta[name] == want, name
    assert riff.inherit_metadata({"slnt": 1, "junk": [b"q"]}, h.meta, junk=True)["junk"] == [b"q", b"xyz"]


def test_broken_files():
    good = codecs.encode_file(np.zeros((3, 1)), "f32", "i16", 8000)
    fmt, data = riff.chunk_bytes(b"fmt ", riff.fmt_bytes(1, 1, 8000, 16000, 2, 16)), riff.chunk_bytes(b"data", b"ab")
    wrap = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body
    for bad in (b"", b"OggS" + good[4:], good[:20], wrap(data), wrap(fmt), wrap(fmt + data + data), wrap(fmt + fmt + data), b"RF64" + good[4:]):
        with pytest.raises((riff.WavError, struct.error)):
            riff.from_bytes(bad)
    broken = wrap(fmt + riff.chunk_bytes(b"smpl", b"short") + riff.chunk_bytes(b"what", b"x") + data)
    assert riff.from_bytes(broken).corrupt == ["smpl"]
    with pytest.raises(riff.WavError):
        riff.from_bytes(broken, mode="FAILFAST")


def test_source_views_and_pushdown(spark, tmp_path):
    wav.register(spark)
    rng = np.random.default_rng(5)
    x = rng.integers(-32768, 32767, (20_000, 2))
    files = [("a.wav", codecs.encode_file(x, "i16", "i16", 44100, meta=META)), ("sub/b.wav", codecs.encode_file(x[:3000], "i16", "ima", 8000)), ("c.wav", codecs.encode_file(x[:10], "i16", "f32", 8000))]
    spark.createDataFrame(files, "path string, content binary").write.format("wav").mode("append").save(str(tmp_path))
    assert not list(tmp_path.rglob("*.part"))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    read = lambda view, **o: spark.read.format("wav").option("view", view).options(**o).load(str(tmp_path))
    info = {r["path"].rsplit("/", 1)[1]: r for r in read("files").collect()}
    assert info["a.wav"]["total_frames"] == 20_000 and info["a.wav"]["spec"]["channels"] == 2 and info["a.wav"]["bext"]["time_ref"] == 2**40
    assert info["a.wav"]["smpl"]["loops"][0]["end"] == 3 and info["a.wav"]["info"]["IART"] == "me"
    whole = read("frames", sampletype="i16", splitBytes="20000").where(F.col("path").endswith("a.wav"))
    assert whole.rdd.getNumPartitions() > 3
    got = sorted((r["frame_idx"], r["samples"]) for r in whole.collect())
    assert [g[1] for g in got] == x.tolist() and [g[0] for g in got] == list(range(20_000))
    cut = read("frames", sampletype="i16").where((F.col("path") == str(tmp_path / "a.wav")) & (F.col("frame_idx") >= 4090) & (F.col("frame_idx") < 4100))
    assert sorted((r["frame_idx"], r["samples"]) for r in cut.collect()) == [(k, x[k].tolist()) for k in range(4090, 4100)]
    ima = read("frames", sampletype="i16").where(F.col("path").endswith("b.wav"))
    every = {r["frame_idx"]: r["samples"] for r in ima.collect()}
    assert {r["frame_idx"]: r["samples"] for r in ima.where("frame_idx = 1500").collect()} == {1500: every[1500]}
    blocks = read("blocks").where(F.col("path").endswith("b.wav"))
    assert blocks.agg(F.sum("n_frames")).first()[0] == len(every)
    assert read("cues").count() == 2 and read("plst").count() == 1 and read("adtl").count() == 3 and read("info").count() == 4 and read("chunks").where("flag = 'data'").count() == 3
    cues = metadata.full_cue_points(read("cues"), read("adtl"), read("plst")).collect()
    by_id = {r["cue_point_id"]: r for r in cues}
    assert (by_id[1]["note"], by_id[1]["label"], by_id[1]["num_samples"]) == ("a note", "", 10)
    assert (by_id[2]["country"], by_id[2]["language"], by_id[2]["text_data"], by_id[2]["repeats"]) == ("France", "French", "texte", 0)
    with pytest.raises(Exception, match="no text entry"):
        metadata.full_cue_points(read("cues"), read("adtl").where("cue_point_id = 1")).collect()
    assert metadata.full_cue_points(read("cues"), read("adtl").where("cue_point_id = 1"), strict=False).count() == 1


def test_ms_fill_is_coded_once(monkeypatch):
    """What fills a block up costs the steps until the state comes back, not one for each of 2036 samples; all steps give the same."""
    steps, move = [], adpcm.Ms._move
    monkeypatch.setattr(adpcm.Ms, "_move", lambda *a: (steps.append(1), move(*a))[1])
    rng = np.random.default_rng(8)
    for channels in (1, 2):
        for n in (1, 2, 3, 64, 2100):
            x = rng.integers(-20000, 20000, (n, channels)).tolist()
            steps.clear()
            data = adpcm.encode_ms(x, channels)
            back = adpcm.ms_frames(data, channels, 1024 * channels)
            assert len(steps) < 2 * channels * (n + 400)
            states, nibbles = [adpcm.Ms() for _ in range(channels)], []
            for at in range(0, n, 2036):
                part = x[at : at + 2036] + [x[-1]] * (2036 - len(x[at : at + 2036]))
                for c, s in enumerate(states):
                    s.s2, s.s1 = part[0][c], part[1][c]
                plain = [adpcm.Ms(0, s.d, s.s1, s.s2) for s in states]
                block = [part[0], part[1]]
                for f in part[2:]:
                    nibbles = [s.compress(v) for s, v in zip(states, f, strict=True)]
                    block.append([p.expand(k) for p, k in zip(plain, nibbles, strict=True)])
                assert back[at : at + 2036].tolist() == block


@pytest.mark.parametrize("codec", ["u8", "i24", "alaw", "ima", "ms", "yamaha", "flac"])
@pytest.mark.parametrize("channels", [1, 2])
def test_frames_behind_a_filter_are_not_decoded(tmp_path, codec, channels, monkeypatch):
    x = np.random.default_rng(2).uniform(-0.8, 0.8, (2100, channels))
    (tmp_path / "a.wav").write_bytes(codecs.encode_file(x, "f64", codec, 8000))

    def read(least, past):
        reader = wav.WavReader({"path": str(tmp_path), "sampletype": "i16"}, None)
        reader.least, reader.past = least, past
        rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
        return [(r["frame_idx"], r["samples"]) for r in rows]

    every = read(0, 1 << 62)
    sizes, decode = [], codecs.decode
    monkeypatch.setattr(codecs, "decode", lambda *a: (sizes.append(len(decode(*a))), decode(*a))[1])
    for least, past in [(0, 1), (0, 2), (0, 3), (17, 18), (5, 64), (1016, 1018), (2036, 2038), (2099, 2100)]:
        sizes.clear()
        assert read(least, past) == every[least:past]
        assert codec == "flac" or past > 1000 or sum(sizes) <= past + 8


def test_cue_points_write_their_files_once(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(files, "scratch", lambda spark: folders.append(catalogue.scratch(spark)) or folders[-1])
    assert catalogue.QUERIES["cue_points_of_files"](spark, SF).count() == 1000
    assert len(folders) == 1


@pytest.mark.parametrize("name", ["adpcm_files", "ms_files", "flac_roundtrip", "pcm_roundtrip_i16"])
def test_ids_are_read_once_for_a_file(spark, name):
    """An expression over the path of each of a file's frames took longer than reading them."""
    plan = plan_of(catalogue.QUERIES[name](spark, SF)).splitlines()
    groups = [line for line in plan if "Aggregate" in line]
    assert groups and not any("vec_id" in line.split("Aggregate [")[1].split("]")[0] for line in groups)


@pytest.mark.parametrize("view", ["files", "chunks", "blocks", "cues", "plst", "adtl", "info", "junk", "id3", "hash"])
def test_rows_of_views_share_a_batch(spark, tmp_path, view):
    """Rows leave the reader by column: Spark's own conversion of each value took longer than reading the file."""
    rows = catalogue.waves(spark, SF).limit(50).select(wav.content_column(F.col("embedding"), 1, "f32", "i16", 8000, meta=files._meta(), riff_mode="allow").alias("c")).collect()
    for k, r in enumerate(rows):
        (tmp_path / f"{k}.wav").write_bytes(r["c"])
    (tmp_path / "noise.wav").write_bytes(b"noise")
    schema = spark.createDataFrame([], wav.VIEWS[view]).schema
    reader = wav.WavReader({"path": str(tmp_path), "view": view}, schema)
    (batch,) = [b for part in reader.partitions() for b in reader.read(part)]
    assert batch.num_rows >= 50 and batch.schema.names == schema.names
    assert batch.column("path").null_count == 0


def test_commit_moves_files_in_runs(tmp_path, monkeypatch):
    """A thread moves a run of files: 16 threads that took one each waited for each other."""
    from concurrent.futures import ThreadPoolExecutor

    taken, submit = [], ThreadPoolExecutor.submit
    monkeypatch.setattr(ThreadPoolExecutor, "submit", lambda *a: (taken.append(1), submit(*a))[1])
    for overwrite in (False, True):
        writer = wav.WavWriter({"path": str(tmp_path)}, overwrite)
        n = 1100 - 100 * overwrite
        message = writer.write({"path": f"{k % 3}/{k}.wav", "content": b"%d" % k} for k in range(n))
        writer.commit([message, None])
        assert {p.name: p.read_bytes() for p in tmp_path.rglob("*.wav")} == {f"{k}.wav": b"%d" % k for k in range(n)}
        assert not list(tmp_path.glob(".job-*"))
    assert len(taken) == 3 + 2 + 3


@pytest.mark.parametrize("view", ["frames", "mono", "stereo"])
def test_frames_of_small_files_share_a_batch(tmp_path, view):
    rng, told = np.random.default_rng(3), {}
    for k in range(40):
        told[f"{k}.wav"] = rng.integers(-30000, 30000, (1 + k * 100, 1 + k % 2))
        (tmp_path / f"{k}.wav").write_bytes(codecs.encode_file(told[f"{k}.wav"], "i16", "i16", 8000))
    (tmp_path / "none.wav").write_bytes(codecs.encode_file(np.zeros((0, 1), np.int64), "i16", "i16", 8000))
    (tmp_path / "noise.wav").write_bytes(b"noise")
    reader = wav.WavReader({"path": str(tmp_path), "view": view, "sampletype": "i16"}, None)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(batches) == 2
    rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
    shown = {"frames": lambda x: [(v,) for v in x.tolist()], "mono": lambda x: [(v,) for v in np.trunc(x.mean(axis=1)).astype(int).tolist()], "stereo": lambda x: [(v[0], v[-1]) for v in x.tolist()]}[view]
    assert sorted(rows, key=repr) == sorted(((f"{tmp_path}/{name}", k, *v) for name, x in told.items() for k, v in enumerate(shown(x))), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_transcode_loss_joins_nothing(spark):
    """A file is compared where it is coded: samples in rows of their own, broadcast to be joined, took the driver's memory."""
    plan = plan_of(catalogue.transcode_loss(spark, SF))
    assert "Join" not in plan and "Generate" not in plan


def test_coding_noise(spark):
    told = [0.5, None, -0.25, 0.125]
    content = codecs.encode_file(np.array([[0.25], [9.0], [0.5], [-0.25], [0.0], [1.0]]), "f32", "f32", 8000)
    rows = spark.createDataFrame([(told, content), (None, content), (told, None)], "samples array<float>, content binary").coalesce(1)
    assert tuple(waveform.coding_noise(rows).first()) == (0.328125, 0.0625 + 0.75**2 + 0.375**2)
    assert tuple(waveform.coding_noise(rows, block=2).first()) == (0.3125, (0.5 - 9) ** 2 + 1.25**2)
    assert waveform.coding_noise(rows.where("content IS NULL")).collect() == []


def test_transcode_file_by_file(spark):
    """No file's frames are dealt out and gathered again: rows come out as by decoding, resampling and encoding in turn."""
    rng = np.random.default_rng(4)
    files = [(k, codecs.encode_file(rng.uniform(-0.9, 0.9, (n, 2)), "f64", "f32", 8000)) for k, n in enumerate([1, 64, 8191, 20000])]
    contents = spark.createDataFrame([*files, (9, None)], "path long, content binary").coalesce(1)
    out = waveform.transcode(contents, "i16", 8000, 16000)
    assert "Aggregate" not in plan_of(out) and "FlatMapGroups" not in plan_of(out)
    chain = waveform.encode_frames(waveform.resample(waveform.decode_contents(contents), 8000, 16000), "i16", 16000, "f64")
    assert sorted(map(tuple, out.where("content IS NOT NULL").collect())) == sorted(map(tuple, chain.collect()))
    assert out.where("content IS NULL").count() == 1


def test_resample_and_transcode(spark):
    t = np.arange(4096) / 8000
    tone = np.sin(2 * np.pi * 500 * t)
    frames = spark.createDataFrame([("x", k, [float(v)]) for k, v in enumerate(tone)], "path string, frame_idx long, samples array<double>")
    out = sorted((r["frame_idx"], r["samples"][0]) for r in waveform.resample(frames, 8000, 16000).collect())
    assert [k for k, _ in out] == list(range(8192))
    assert abs(np.std([v for _, v in out]) - np.std(tone)) < 0.01
    coded = waveform.encode_frames(frames, "mulaw", 8000, "f64")
    back = waveform.transcode(coded.select("path", "content"), "i16", 8000, 8000).first()
    assert back["n_frames"] == 4096
    assert waveform.next_fft_size(44100, 48000) == 65536


def test_stateful_stream(spark, tmp_path):
    x = np.random.default_rng(3).integers(-20000, 20000, 400).tolist()
    data = adpcm.encode_yamaha([[v] for v in x], 1)
    want = [f[0] for f in adpcm.decode_yamaha(data, 1)]
    schema = "path string, block_idx long, payload binary"
    source = str(tmp_path / "in")
    for k in range(4):
        rows = [("f", k, data[50 * k : 50 * k + 50])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = yamaha_decode_stream(stream).writeStream.format("memory").queryName("yamaha").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [v for r in sorted(spark.table("yamaha").collect(), key=lambda r: r["block_idx"]) for v in r["samples"]]
    assert got == want


def test_spec_functions(spark):
    one = spark.range(1)
    row = one.select(
        spec.guid_text(F.lit(riff.GUID_PCM)), spec.little_endian(F.unhex(F.lit("0102")), 2), spec.zero_terminated(F.lit("a")), spec.all_zero(F.lit(b"")),
        spec.sample_format(F.lit(0xFFFE), F.lit(32), F.lit("float")), spec.sample_bytes(F.lit("S24")), spec.process_size(F.lit(44100), F.lit(48000)), spec.mask_names(F.lit(5)),
    ).first()
    assert row[0] == "00000001-0000-0010-8000-00AA00389B71" and row[1] == 513 and row[2] == "a\0" and row[3] and row[4] == "Float" and row[5] == 3
    assert row[6] == 65536 * 44100 // 48000 and row[7] == ["front_left", "front_center"]


def test_writer_replaces_and_leaves_nothing(spark, tmp_path):
    """Overwrite removes what was there; a failed job leaves neither files nor its folder."""
    wav.register(spark)
    folder = tmp_path / "out"

    def names():
        return sorted(str(p.relative_to(folder)) for p in folder.rglob("*"))

    rows = lambda *paths: spark.createDataFrame([(p, bytearray(b"x")) for p in paths], "path string, content binary").coalesce(1)
    rows("a.wav", "sub/b.wav").write.format("wav").mode("append").save(str(folder))
    assert names() == ["a.wav", "sub", "sub/b.wav"]
    rows("c.wav").write.format("wav").mode("append").save(str(folder))
    assert names() == ["a.wav", "c.wav", "sub", "sub/b.wav"]
    rows("a.wav").write.format("wav").mode("overwrite").save(str(folder))
    assert [n for n in names() if n.endswith(".wav")] == ["a.wav"]
    broken = rows("d.wav", "e.wav").withColumn("content", F.when(F.col("path") == "d.wav", F.col("content")))
    with pytest.raises(Exception):
        broken.write.format("wav").mode("append").save(str(folder))
    assert [n for n in names() if n.endswith(".wav")] == ["a.wav"] and not [n for n in names() if "job" in n]


def test_container_length_and_extensions(spark, tmp_path):
    x = np.arange(-50, 50)[:, None]
    raw = codecs.encode_file(x, "i16", "i16", 8000)
    assert len(riff.from_bytes(raw + riff.chunk_bytes(b"junk", b"abcd")).chunks) == len(riff.from_bytes(raw).chunks) == 2
    streamed = raw[:4] + b"\xff\xff\xff\xff" + raw[8:]
    assert riff.from_bytes(streamed).data.size == 200
    ext = struct.pack("<HIHHH", 1, 2, 417, 1, 1393)
    h = riff.from_bytes(riff.container_bytes(riff.fmt_bytes(0x55, 2, 44100, 16000, 1, 0, ext), b"mp3!"))
    assert h.fmt["ext_kind"] == "mp3" and h.fmt["ext_values"] == {"id": 1, "flags": 2, "block_size": 417, "frames_per_block": 1, "codec_delay": 1393}
    ogg = riff.from_bytes(riff.container_bytes(riff.fmt_bytes(0x6750, 2, 44100, 16000, 1, 0, struct.pack("<II", 5, 6) + b"head"), b""))
    assert ogg.fmt["ext_kind"] == "oggvorbis-header" and ogg.fmt["ext_values"] == {"codec_version": 5, "vorbis_version": 6}
    with pytest.raises(riff.WavError, match="too short"):
        riff.from_bytes(riff.container_bytes(riff.fmt_bytes(0x55, 2, 44100, 16000, 1, 0, ext[:6]), b""))
    assert codecs.total_frames("mp3", h.fmt, 4) is None
    # an MS file with coefficients of its own decodes by them
    ms = codecs.encode_file(x * 100, "i16", "ms", 8000)
    at = ms.index(struct.pack("<hh", *adpcm.MS_COEFFS[0]))
    other = riff.from_bytes(changed := ms[:at] + struct.pack("<hh", 128, 0) + ms[at + 4 :])
    data = changed[other.data.offset : other.data.offset + other.data.size]
    assert other.fmt["coefficients"][0] == (128, 0)
    assert codecs.decode("ms", data, other.fmt, "i16").tolist() != codecs.decode("ms", data, riff.from_bytes(ms).fmt, "i16").tolist()
    (tmp_path / "a.wav").write_bytes(codecs.encode_file(x, "i16", "flac", 8000))
    wav.register(spark)
    read = lambda view, **o: spark.read.format("wav").option("view", view).options(**o).load(str(tmp_path))
    assert read("blocks").first()["n_frames"] == 100
    (tmp_path / "b.wav").write_bytes(codecs.encode_file(wav.widen(x[:, 0], 6), "i16", "i16", 8000))
    six = read("stereo", sampletype="i16").where(F.col("path").endswith("b.wav") & (F.col("frame_idx") >= 60)).collect()
    assert len(six) == 40
    gains = waveform.gains(spec.DEFAULT_MASKS[6])
    assert sorted((r["frame_idx"], r["l"]) for r in six)[:2] == [(k, int((k - 50) * sum(gains[0]))) for k in (60, 61)]
    assert [r["sample"] for r in read("mono", sampletype="i16").where("frame_idx = 99").collect()] == [49, 49]


def test_id3_text():
    frames = [("TIT2", "Größe"), ("TRCK", "3/9"), ("TALB", "x" * 300)]
    tag = riff.id3_bytes(frames)
    assert riff.id3_frames(tag) == frames and riff.id3_frames(b"ID3") == riff.id3_frames(b"x" * 20) == []
    old = b"ID3\3\0\0" + bytes([0, 0, 0, 28]) + b"TIT2" + (11).to_bytes(4, "big") + b"\0\0\1" + "﻿name".encode("utf-16-le") + b"TXXX"
    assert riff.id3_frames(old) == [("TIT2", "name")]
    assert riff.id3_frames(tag + bytes(50)) == frames
