"""The queries of the waveform operators and their DuckDB SQL.

Waveforms are the ``embeddings`` rows (64 values each); cue points, playlists
and text entries are stood in for by ``lineitem``, ``orders`` and ``part``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.functions import adpcm, samples, spec
from wavequarry.operators import metadata, waveform
from wavequarry.sources import wav

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="wavequarry-")
    return f"{base.rstrip('/')}/wav-{uuid.uuid4().hex}"


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waveforms dealt to all cores: a small file is one task, and coding a sample takes long."""
    return waves(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "vec_id")


def i16(values: Column | str = "embedding") -> Column:
    return samples.scale_all(F.col(values) if isinstance(values, str) else values, "f32", "i16")


def each(df: DataFrame, values: Column, name: str = "sample", kind: str = "long") -> DataFrame:
    """One row for each value, with its place."""
    out = df.select("vec_id", F.posexplode(values).alias("pos", "v"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast(kind).alias(name))


_I16 = "list_transform(embedding, lambda x: CAST(trunc(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * 32767) AS BIGINT))"
_SRC = f"src AS (SELECT vec_id, {_I16} AS xs FROM embeddings)"
_EACH = "SELECT vec_id, CAST(unnest(range(len(xs))) AS BIGINT) AS pos, CAST(unnest(xs) AS {kind}) AS {name} FROM {of}"


def _listed(expression: str, name: str = "sample", kind: str = "BIGINT") -> str:
    return f"WITH {_SRC}, t AS (SELECT vec_id, {expression} AS xs FROM src) " + _EACH.format(kind=kind, name=name, of="t")


# ---- sample conversion ----


def _scaled(bits: int, signed: bool) -> str:
    shift = "" if signed else f" + {2 ** (bits - 1)}"
    return f"WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * {2 ** (bits - 1) - 1}) AS BIGINT){shift}) AS xs FROM embeddings) " + _EACH.format(kind="BIGINT", name="sample", of="t")


def _scale_query(target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return each(waves(spark, sf_dir), samples.scale_all(F.col("embedding"), "f32", target))

    return run


for _target in ("i8", "u8", "i16", "u16", "i24", "u24", "i32", "u32"):
    query(_scaled(int(_target[1:]), _target[0] == "i"), f"scale_f32_{_target}")(_scale_query(_target))


@query(_listed("list_transform(xs, lambda x: CAST(x AS DOUBLE) / 32767)", kind="DOUBLE"))
def scale_i16_f64(spark, sf_dir):
    return each(waves(spark, sf_dir), samples.scale_all(i16(), "i16", "f64"), kind="double")


@query(_listed("list_transform(xs, lambda x: x * 65536)"))
def scale_i16_i32(spark, sf_dir):
    return each(waves(spark, sf_dir), samples.scale_all(i16(), "i16", "i32"))


@query(_listed("list_transform(xs, lambda x: (x >> 8) + 128)"))
def scale_i16_u8(spark, sf_dir):
    return each(waves(spark, sf_dir), samples.scale_all(i16(), "i16", "u8"))


@query(_listed("list_transform(xs, lambda x: (x * 65536) >> 12)"))
def flac_bit_fit(spark, sf_dir):
    return each(waves(spark, sf_dir), F.transform(samples.scale_all(i16(), "i16", "i32"), lambda x: samples.flac_fit(x, 20)))


# ---- the container: sink, source, pushdown ----


def _stored(spark: SparkSession, sf_dir: str, codec: str, channels: int = 1) -> str:
    """Every waveform written as a file; the folder."""
    wav.register(spark)
    folder = scratch(spark)
    content = wav.content_column(F.col("embedding"), channels, "f32", codec, 8000)
    spread(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), content.alias("content")).write.format("wav").mode("append").save(folder)
    return folder


def _load(spark: SparkSession, folder: str, view: str, **options) -> DataFrame:
    return spark.read.format("wav").option("view", view).options(**options).load(folder)


def _id() -> Column:
    return F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("long").alias("vec_id")


def _read(spark: SparkSession, folder: str, view: str, **options) -> DataFrame:
    return _load(spark, folder, view, **options).select("*", _id())


def by_file(frames: DataFrame, **values: Column) -> DataFrame:
    """Aggregates of each file: its id is read from the path once, not for every frame."""
    return frames.groupBy("path").agg(*[v.alias(k) for k, v in values.items()]).select(_id(), *values)


def _roundtrip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = _load(spark, _stored(spark, sf_dir, kind), "frames", sampletype=kind)
        value = F.col("samples")[0].cast("double" if kind[0] == "f" else "long")
        return by_file(frames, n=F.count(F.lit(1)), low=F.min(value), high=F.max(value), total=F.sum(F.round(value * (1e6 if kind[0] == "f" else 1)).cast("long")))

    return run


for _kind in ("u8", "i16", "i24", "i32", "f32"):
    _value = "CAST(x AS DOUBLE)" if _kind == "f32" else f"CAST(trunc(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * {2 ** (int(_kind[1:]) - 1) - 1}) AS BIGINT)" + (" + 128" if _kind == "u8" else "")
    _total = "CAST(round(v * 1e6) AS BIGINT)" if _kind == "f32" else "v"
    query(
        f"WITH t AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_value})) AS v FROM embeddings) SELECT vec_id, count(*) AS n, min(v) AS low, max(v) AS high, CAST(sum({_total}) AS BIGINT) AS total FROM t GROUP BY vec_id",
        f"pcm_roundtrip_{_kind}",
    )(_roundtrip(_kind))


@query("SELECT vec_id, 'RIFF' AS container, 2 AS channels, CAST(8000 AS BIGINT) AS sample_rate, 16 AS bits, CAST(32 AS BIGINT) AS total_frames, CAST(128 AS BIGINT) AS data_length FROM embeddings")
def wav_files(spark, sf_dir):
    files = _read(spark, _stored(spark, sf_dir, "i16", 2), "files")
    return files.select("vec_id", "container", F.col("spec.channels").alias("channels"), F.col("spec.sample_rate").alias("sample_rate"), F.col("spec.bits_per_sample").alias("bits"), "total_frames", "data_length")


@query("SELECT flag, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT unnest(['fmt ', 'data']) AS flag, unnest([16, 128]) AS size FROM embeddings) GROUP BY flag")
def wav_chunks(spark, sf_dir):
    chunks = _read(spark, _stored(spark, sf_dir, "i16"), "chunks")
    return chunks.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("SELECT vec_id, CAST(0 AS BIGINT) AS block_idx, CAST(0 AS BIGINT) AS first_frame, 64 AS n_frames, 128 AS bytes FROM embeddings")
def wav_blocks(spark, sf_dir):
    return _read(spark, _stored(spark, sf_dir, "i16"), "blocks").select("vec_id", "block_idx", "first_frame", "n_frames", F.octet_length("payload").alias("bytes"))


@query(f"WITH {_SRC} SELECT vec_id, CAST(xs[18] AS BIGINT) AS sample FROM src")
def seek_nth(spark, sf_dir):
    """The frame at 17, by a filter that reaches the reader."""
    frames = _read(spark, _stored(spark, sf_dir, "i16"), "frames", sampletype="i16").where("frame_idx = 17")
    return frames.select("vec_id", F.col("samples")[0].cast("long").alias("sample"))


@query(f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, xs[2 * i + 1] AS l, xs[2 * i + 2] AS r FROM src, range(5, 20) AS g(i)")
def frame_slice(spark, sf_dir):
    frames = _read(spark, _stored(spark, sf_dir, "i16", 2), "frames", sampletype="i16").where("frame_idx >= 5 AND frame_idx < 20")
    return frames.select("vec_id", "frame_idx", F.col("samples")[0].cast("long").alias("l"), F.col("samples")[1].cast("long").alias("r"))


@query("WITH src AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * 2147483647) AS BIGINT) >> 16) AS xs FROM embeddings) SELECT vec_id, CAST(64 AS BIGINT) AS n, CAST(list_sum(xs) * 65536 AS BIGINT) AS total FROM src")
def flac_roundtrip(spark, sf_dir):
    """FLAC files of 16 bits read back in the 32-bit range."""
    frames = _load(spark, _stored(spark, sf_dir, "flac"), "frames", sampletype="i32")
    return by_file(frames, n=F.count(F.lit(1)), total=F.sum(F.col("samples")[0].cast("long")))


@query()
def adpcm_files(spark, sf_dir):
    """IMA, MS and Yamaha files read back: frames by codec and file."""
    value = F.col("samples")[0].cast("long")
    parts = [by_file(_load(spark, _stored(spark, sf_dir, c), "frames", sampletype="i16"), n=F.count(F.lit(1)), total=F.sum(value)).withColumn("codec", F.lit(c)) for c in ("ima", "ms", "yamaha")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def transcode_summary(spark, sf_dir):
    """Files at 8 kHz resampled to 16 kHz and stored as mu-law: frames and level of each."""
    content = wav.content_column(F.col("embedding"), 1, "f32", "f32", 8000)
    coded = waveform.transcode(spread(spark, sf_dir).select("vec_id", content.alias("content")), "mulaw", 8000, 16000, "vec_id")
    level = waveform.decode_contents(coded.select("vec_id", "content"), "f64", "vec_id")
    return level.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("samples")[0], 2))), 3).alias("level"))


@query()
def transcode_loss(spark, sf_dir):
    """Signal-to-noise ratio in dB of each codec's round trip over all waveforms."""
    parts = []
    for codec in ("alaw", "mulaw", "ima", "ms", "yamaha", "flac"):
        content = wav.content_column(F.col("embedding"), 1, "f32", codec, 8000)
        # a block's first frame of IMA is its header's sample, the state before the block
        sums = waveform.coding_noise(spread(spark, sf_dir).select(F.col("embedding").alias("samples"), content.alias("content")), 1017 if codec == "ima" else 0)
        parts.append(sums.agg((10 * F.log10(F.sum("signal") / F.sum("noise"))).alias("snr_db")).select(F.lit(codec).alias("codec"), F.round("snr_db", 2).alias("snr_db")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# ---- channel shapes ----


@query(_listed("xs").replace("SELECT vec_id, CAST(unnest(range", "SELECT vec_id, CAST(unnest(list_transform(range(len(xs)), lambda i: i % 2)) AS BIGINT) AS channel, CAST(unnest(range"))
def deinterleave_stereo(spark, sf_dir):
    channels = samples.deinterleave(i16(), 2)
    out = waves(spark, sf_dir).select("vec_id", F.posexplode(channels).alias("channel", "xs")).select("vec_id", "channel", F.posexplode("xs").alias("k", "v"))
    return out.select("vec_id", F.col("channel").cast("long").alias("channel"), (F.col("k") * 2 + F.col("channel")).cast("long").alias("pos"), F.col("v").cast("long").alias("sample"))


@query(_listed("xs"))
def interleave(spark, sf_dir):
    return each(waves(spark, sf_dir), samples.interleave(samples.deinterleave(i16(), 4)))


@query(f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, xs[2 * i + 1] AS l, xs[2 * i + 2] AS r FROM src, range(32) AS g(i)")
def frames_stereo(spark, sf_dir):
    out = waves(spark, sf_dir).select("vec_id", F.posexplode(samples.frames(i16(), 2)).alias("frame_idx", "f"))
    return out.select("vec_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("f")[0].cast("long").alias("l"), F.col("f")[1].cast("long").alias("r"))


_FRAME4 = "xs[4 * i + 1] + xs[4 * i + 2] + xs[4 * i + 3] + xs[4 * i + 4]"


def _frames4(spark, sf_dir, value) -> DataFrame:
    out = waves(spark, sf_dir).select("vec_id", F.posexplode(samples.frames(i16(), 4)).alias("frame_idx", "f"))
    return out.select("vec_id", F.col("frame_idx").cast("long").alias("frame_idx"), value(F.col("f")).alias("mono"))


@query(f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, CAST({_FRAME4} AS DOUBLE) / 4 AS mono FROM src, range(16) AS g(i)")
def mono_mean(spark, sf_dir):
    return _frames4(spark, sf_dir, samples.mean)


@query(f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, CAST(trunc(CAST({_FRAME4} AS DOUBLE) / 4) AS BIGINT) AS mono FROM src, range(16) AS g(i)")
def mono_int_mean(spark, sf_dir):
    return _frames4(spark, sf_dir, samples.integer_mean)


@query(f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, round(xs[4 * i + 1] + CAST({waveform.SIDE} AS DOUBLE) * xs[4 * i + 3], 6) AS l, round(xs[4 * i + 2] + CAST({waveform.SIDE} AS DOUBLE) * xs[4 * i + 4], 6) AS r FROM src, range(16) AS g(i)")
def downmix_matrix(spark, sf_dir):
    mixed = _frames4(spark, sf_dir, lambda f: samples.downmix(f, waveform.gain_column(0x33)))
    return mixed.select("vec_id", "frame_idx", F.round(F.col("mono")[0], 6).alias("l"), F.round(F.col("mono")[1], 6).alias("r"))


@query(f"WITH {_SRC} SELECT vec_id, CAST(i // 20 AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS n, CAST(sum(xs[i + 1]) AS BIGINT) AS total FROM src, range(64) AS g(i) GROUP BY ALL")
def block_opus(spark, sf_dir):
    """Blocks of 2.5 ms at 8 kHz: 20 samples."""
    rows = each(waves(spark, sf_dir), i16())
    return rows.groupBy("vec_id", F.floor(F.col("pos") / 20).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("sample").alias("total"))


@query(_listed("list_concat(xs, list_transform(range(16), lambda i: CAST(0 AS BIGINT)))"))
def block_pad(spark, sf_dir):
    return each(waves(spark, sf_dir), samples.pad_block(i16(), 20))


# ---- companding ----

_MU_SIZE = "least(abs(x), 32635) + 132"
_MU_SEGMENT = f"CASE WHEN {_MU_SIZE} < 256 THEN 0 WHEN {_MU_SIZE} < 512 THEN 1 WHEN {_MU_SIZE} < 1024 THEN 2 WHEN {_MU_SIZE} < 2048 THEN 3 WHEN {_MU_SIZE} < 4096 THEN 4 WHEN {_MU_SIZE} < 8192 THEN 5 WHEN {_MU_SIZE} < 16384 THEN 6 ELSE 7 END"
_MU = f"list_transform(xs, lambda x: 255 - ((CASE WHEN x < 0 THEN 128 ELSE 0 END) + ({_MU_SEGMENT}) * 16 + (({_MU_SIZE}) >> (({_MU_SEGMENT}) + 3)) % 16))"
_MU_BACK = "(((255 - c) % 16 * 8 + 132) << ((255 - c) % 128 // 16)) - 132"
_A_SIZE = "(CASE WHEN (x >> 3) >= 0 THEN x >> 3 ELSE -(x >> 3) - 1 END)"
_A_SEGMENT = f"(CASE WHEN {_A_SIZE} < 32 THEN 0 WHEN {_A_SIZE} < 64 THEN 1 WHEN {_A_SIZE} < 128 THEN 2 WHEN {_A_SIZE} < 256 THEN 3 WHEN {_A_SIZE} < 512 THEN 4 WHEN {_A_SIZE} < 1024 THEN 5 WHEN {_A_SIZE} < 2048 THEN 6 ELSE 7 END)"
_A = f"list_transform(xs, lambda x: xor(CAST({_A_SEGMENT} * 16 + ({_A_SIZE} >> greatest({_A_SEGMENT}, 1)) % 16 AS BIGINT), CAST(CASE WHEN (x >> 3) >= 0 THEN 213 ELSE 85 END AS BIGINT)))"
_A_BITS = "xor(CAST(c AS BIGINT), CAST(85 AS BIGINT))"
_A_BACK = f"({_A_BITS} % 16 * 16 + CASE WHEN {_A_BITS} % 128 // 16 = 0 THEN 8 ELSE 264 END) << greatest({_A_BITS} % 128 // 16 - 1, 0)"


@query(_listed(_MU, "code"))
def mulaw_enc(spark, sf_dir):
    return each(waves(spark, sf_dir), F.transform(i16(), samples.mulaw_encode), "code")


@query(_listed(f"list_transform({_MU}, lambda c: CASE WHEN 255 - c >= 128 THEN -({_MU_BACK}) ELSE {_MU_BACK} END)"))
def mulaw_dec(spark, sf_dir):
    return each(waves(spark, sf_dir), F.transform(i16(), lambda x: samples.mulaw_decode(samples.mulaw_encode(x))))


@query(_listed(_A, "code"))
def alaw_enc(spark, sf_dir):
    return each(waves(spark, sf_dir), F.transform(i16(), samples.alaw_encode), "code")


@query(_listed(f"list_transform({_A}, lambda c: CASE WHEN {_A_BITS} >= 128 THEN {_A_BACK} ELSE -({_A_BACK}) END)"))
def alaw_dec(spark, sf_dir):
    return each(waves(spark, sf_dir), F.transform(i16(), lambda x: samples.alaw_decode(samples.alaw_encode(x))))


# ---- ADPCM: folds against recursive SQL ----


def _fold_sql(state: dict[str, int], steps: list[list[str]], name: str, source: str = _SRC) -> str:
    """A recursion over ``xs``: each of ``steps`` adds columns that the next one may use; ``o`` is the output."""
    keys = ", ".join(state)
    inner = "SELECT f.*, src.xs[f.pos + 1] AS x, len(src.xs) AS size FROM f JOIN src USING (vec_id) WHERE f.pos < len(src.xs)"
    for k, columns in enumerate(steps):
        inner = f"SELECT *, {', '.join(columns)} FROM ({inner}) s{k}"
    new = ", ".join(f"CAST(n_{k} AS BIGINT)" for k in state)
    first = ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in state.items())
    return (
        f"WITH RECURSIVE {source}, f AS (SELECT vec_id, CAST(0 AS BIGINT) AS pos, {first}, CAST(0 AS BIGINT) AS o FROM src "
        f"UNION ALL SELECT vec_id, pos + 1, {new}, CAST(n_o AS BIGINT) FROM ({inner}) t) SELECT vec_id, pos - 1 AS pos, o AS {name} FROM f WHERE pos > 0 -- {keys}"
    )


def _array(values: list[int]) -> str:
    return f"[{', '.join(map(str, values))}]"


_IMA_TAIL = [
    [f"({_array(adpcm.IMA_STEP)}[i + 1] * (nib % 8 * 2 + 1)) >> 3 AS q", f"greatest(least(i + {_array(adpcm.IMA_INDEX)}[nib + 1], 88), 0) AS n_i"],
    ["greatest(least(CASE WHEN nib >= 8 THEN p - q ELSE p + q END, 32767), -32768) AS n_p"],
]
_IMA_NIB = [f"least(abs(x - p) * 4 // {_array(adpcm.IMA_STEP)}[i + 1], 7) + CASE WHEN x < p THEN 8 ELSE 0 END AS nib"]
_MS_TAIL = [
    ["CASE WHEN nib >= 8 THEN nib - 16 ELSE nib END AS signed"],
    ["greatest(least(pred + signed * d, 32767), -32768) AS n_s1", "s1 AS n_s2", f"greatest(({_array(adpcm.MS_ADAPT)}[nib + 1] * d) >> 8, 16) AS n_d"],
]
_MS_PRED = ["CAST(trunc((s1 * 256 + s2 * 0) / 256) AS BIGINT) AS pred"]
_MS_NIB = [
    ["x - pred AS rest"],
    ["rest + CASE WHEN rest >= 0 THEN CAST(trunc(d / 2) AS BIGINT) ELSE CAST(trunc(-d / 2) AS BIGINT) END AS biased"],
    ["(greatest(least(CAST(trunc(biased / d) AS BIGINT), 7), -8) + 16) % 16 AS nib"],
]
_YAMAHA_TAIL = [
    [f"p + greatest(least(CAST(trunc(s * {_array(adpcm.YAMAHA_DIFF)}[nib + 1] / 8) AS BIGINT), 32767), -32768) AS n_p", f"greatest(least((s * {_array(adpcm.YAMAHA_SCALE)}[nib + 1]) >> 8, 24576), 127) AS n_s"],
]
_YAMAHA_NIB = ["least(abs(x - p) * 4 // s, 7) + CASE WHEN x < p THEN 8 ELSE 0 END AS nib"]
#: Nibbles to decode: the top four bits of each sample.
_NIBBLES = f"src AS (SELECT vec_id, list_transform({_I16}, lambda x: (x + 32768) // 16 % 16) AS xs FROM embeddings)"


def nibbles() -> Column:
    return F.transform(i16(), lambda x: F.floor((x.cast("long") + 32768) / 16) % 16)


@query(_fold_sql({"p": 0, "i": 0}, [_IMA_NIB, *_IMA_TAIL, ["nib AS n_o"]], "nibble"))
def ima_enc(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.ima_encode(i16()), "nibble")


@query(_fold_sql({"p": 0, "i": 0}, [["x AS nib"], *_IMA_TAIL, ["n_p AS n_o"]], "sample", _NIBBLES))
def ima_dec(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.ima_decode(nibbles()))


@query(_fold_sql({"s1": 0, "s2": 0, "d": 16}, [_MS_PRED, *_MS_NIB, *_MS_TAIL, ["nib AS n_o"]], "nibble"))
def ms_enc(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.ms_encode(i16()), "nibble")


@query(_fold_sql({"s1": 0, "s2": 0, "d": 16}, [[_MS_PRED[0], "x AS nib"], *_MS_TAIL[:1], [*_MS_TAIL[1][:2], _MS_TAIL[1][2].replace(" AS n_d", " AS d_")], [f"least(d_, {(2**31 - 1) // 768}) AS n_d", "n_s1 AS n_o"]], "sample", _NIBBLES))
def ms_dec(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.ms_decode(nibbles()))


@query(_fold_sql({"p": 0, "s": 127}, [_YAMAHA_NIB, *_YAMAHA_TAIL, ["nib AS n_o"]], "nibble"))
def yamaha_enc(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.yamaha_encode(i16()), "nibble")


@query(_fold_sql({"p": 0, "s": 127}, [["x AS nib"], *_YAMAHA_TAIL, ["((n_p + 32768) % 65536 + 65536) % 65536 - 32768 AS n_o"]], "sample", _NIBBLES))
def yamaha_dec(spark, sf_dir):
    return each(waves(spark, sf_dir), adpcm.yamaha_decode(nibbles()))


# ---- format arithmetic ----

_SPEC = "spec AS (SELECT c_custkey AS k, 1 + c_custkey % 8 AS channels, [8000, 11025, 22050, 44100, 48000][1 + c_custkey % 5] AS rate, [8, 16, 24, 32, 64][1 + c_custkey % 5] AS bits FROM customer)"


def _spec(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), (1 + k % 8).cast("int").alias("channels"), pick(8000, 11025, 22050, 44100, 48000).alias("rate"), pick(8, 16, 24, 32, 64).alias("bits"))


@query(
    f"WITH {_SPEC} SELECT k, CASE bits WHEN 8 THEN 'U8' WHEN 16 THEN 'S16' WHEN 24 THEN 'S24' WHEN 32 THEN 'S32' ELSE 'S64' END AS kind, CAST(rate * channels * (bits // 8) AS BIGINT) AS byte_rate, "
    "CAST(channels * (bits // 8) AS BIGINT) AS block_align, CAST(144 * 128000 // rate % 65536 AS INTEGER) AS mp3_block, CASE WHEN rate <= 28000 THEN 576 ELSE 1152 END AS granule, "
    "CASE WHEN rate <= 8000 THEN 8000 WHEN rate <= 12000 THEN 12000 WHEN rate <= 16000 THEN 16000 WHEN rate <= 24000 THEN 24000 ELSE 48000 END AS opus, CAST(rate * 200 * channels // 10000 AS BIGINT) AS opus_block, "
    "CAST(pow(2, ceil(log2(greatest(rate, 16000)))) AS INTEGER) AS fft, CAST(512 * channels AS BIGINT) AS ima_align, CAST(rate * channels * 512 // 1017 AS BIGINT) AS ima_rate FROM spec"
)
def spec_math(spark, sf_dir):
    c, r, b = F.col("channels"), F.col("rate"), F.col("bits")
    kind = spec.sample_type(b, spec.sample_format(F.lit(1), b, F.lit(None).cast("string")))
    ima = spec.adpcm_layout("ima", c, r)
    return _spec(spark, sf_dir).select(
        "k", kind.alias("kind"), spec.pcm_byte_rate(r, c, b).alias("byte_rate"), spec.pcm_block_align(c, b).alias("block_align"), spec.mp3_block_size(F.lit(128000), r).alias("mp3_block"),
        spec.mp3_granule(r).alias("granule"), spec.opus_rate(r).alias("opus"), spec.opus_block(r, c, 200).alias("opus_block"), spec.fft_size(r, F.lit(16000)).alias("fft"),
        ima["block_align"].alias("ima_align"), ima["byte_rate"].alias("ima_rate"),
    )


_STEPS = range(11)
_BITRATE_ROWS = ", ".join(f"({rate}, {channels}, {q}, {bits})" for (rate, channels), row in spec.VORBIS_BITRATES.items() for q, bits in zip(_STEPS, row, strict=True))


@query(f"WITH {_SPEC} SELECT k, s.rate, CAST(s.channels AS INTEGER) AS channels, CAST(q AS INTEGER) AS step, CAST(b.bitrate AS INTEGER) AS bitrate FROM spec s CROSS JOIN range(11) AS g(q) LEFT JOIN (VALUES {_BITRATE_ROWS}) AS b(rate, channels, step, bitrate) ON b.rate = s.rate AND b.channels = s.channels AND b.step = q")
def vorbis_bitrate(spark, sf_dir):
    """The bitrate at all eleven quality steps; null for other rates and channels."""
    steps = F.array(*[F.struct(F.lit(q).alias("step"), spec.vorbis_bitrate(F.col("rate"), F.col("channels"), F.lit(q / 10)).alias("bitrate")) for q in _STEPS])
    return _spec(spark, sf_dir).select("k", "rate", "channels", F.explode(steps).alias("s")).select("k", "rate", "channels", "s.step", "s.bitrate")


@query("SELECT c_custkey AS k, array_to_string(list_filter(list_transform(range(18), lambda b: CASE WHEN (c_custkey >> b) & 1 = 1 THEN CAST(1 << b AS VARCHAR) END), lambda v: v IS NOT NULL), ',') AS positions, CAST(bit_count(CAST(c_custkey AS BIGINT)) = 2 AS BOOLEAN) AS stereo FROM customer")
def mask_to_speakers(spark, sf_dir):
    mask = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.transform(spec.mask_positions(mask), lambda v: v.cast("string")), ",").alias("positions"), spec.mask_is_valid(mask, F.lit(2)).alias("stereo"))


@query(f"WITH {_SPEC} SELECT k, CASE channels WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 51 WHEN 5 THEN 55 WHEN 6 THEN 1551 WHEN 7 THEN 1807 ELSE 1599 END AS mask FROM spec")
def guess_mask(spark, sf_dir):
    return _spec(spark, sf_dir).select("k", spec.guess_mask(F.col("channels")).alias("mask"))


@query("SELECT doc_id, n_chars + n_chars % 2 AS aligned FROM documents")
def chunk_align(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", spec.align(F.col("n_chars")).alias("aligned"))


@query("SELECT page_id, page_id % 3 = 0 AS zero FROM pages")
def junk_all_zero(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 == 0, F.repeat(F.lit("\0"), (F.col("page_id") % 7).cast("int"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", spec.all_zero(body.cast("binary")).alias("zero"))


@query("SELECT page_id, CAST(i AS BIGINT) AS section, sha256(substr(html, CAST(i * 4096 + 1 AS BIGINT), 4096)) AS hash FROM pages, range(0, 1000000) AS g(i) WHERE i <= length(html) // 4096")
def section_hash(spark, sf_dir):
    """The hash of every section of 4096 characters of a page."""
    sections = F.transform(F.sequence(F.lit(0), F.floor(F.length("html") / 4096).cast("int")), lambda i: F.struct(i.cast("long").alias("section"), F.sha2(F.substr(F.col("html"), i * 4096 + 1, F.lit(4096)), 256).alias("hash")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(sections).alias("s")).select("page_id", "s.section", "s.hash")


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) AS frames, CAST(sum(n_chars) * 8 * 44100 // count(*) AS BIGINT) AS bitrate, lang FROM documents GROUP BY lang")
def measured_bitrate(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("bytes"), F.count(F.lit(1)).alias("frames"))
    return out.withColumn("bitrate", spec.measured_bitrate(F.col("bytes"), F.lit(44100), F.col("frames")))


# ---- text metadata ----

_INFO = "SELECT doc_id, unnest(['IART', 'INAM', 'ITRK', 'ilng']) AS key, unnest([source, 'doc ' || doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x' END, lang]) AS value FROM documents"


def _info(spark, sf_dir) -> DataFrame:
    doc = F.col("doc_id").cast("string")
    entries = F.create_map(F.lit("IART"), F.col("source"), F.lit("INAM"), F.concat(F.lit("doc "), doc), F.lit("ITRK"), F.when(F.col("doc_id") % 2 == 0, doc).otherwise("x"), F.lit("ilng"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", entries.alias("info"))


@query(f"WITH i AS ({_INFO}) SELECT doc_id, i.key, value, d.comment FROM i LEFT JOIN (VALUES ('IART', 'ARTIST'), ('INAM', 'TITLE'), ('ITRK', 'TRACKNUMBER')) AS d(k, comment) ON i.key = d.k WHERE d.comment IS NOT NULL")
def info_map(spark, sf_dir):
    """INFO entries in key order, by their comment names."""
    rows = _info(spark, sf_dir).select("doc_id", F.explode(metadata.info_in_order(F.col("info"))).alias("e")).select("doc_id", "e.key", "e.value")
    return metadata.to_comments(rows)


@query(f"WITH i AS ({_INFO}) SELECT * FROM i UNION ALL SELECT doc_id, upper(key), value FROM i WHERE key <> upper(key)")
def info_upper_fill(spark, sf_dir):
    return _info(spark, sf_dir).select("doc_id", F.explode(metadata.upper_fill(F.col("info"))).alias("key", "value"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS track FROM documents")
def track_no(spark, sf_dir):
    return _info(spark, sf_dir).select("doc_id", spec.track_number(F.col("info")["ITRK"]).alias("track"))


_COUNTRY = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in metadata.COUNTRIES.items()) + " ELSE 'Unknown country code ' || code END"


@query(f"SELECT n_nationkey * 3 AS code, {_COUNTRY.replace('CASE code', 'CASE n_nationkey * 3').replace('|| code', '|| (n_nationkey * 3)')} AS country_name FROM nation")
def country_lookup(spark, sf_dir):
    return metadata.with_country(table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("int").alias("code")), "code")


_LANGUAGE = "CASE " + " ".join(f"WHEN l = {a} AND d = {b} THEN '{v}'" for (a, b), v in metadata.LANGUAGES.items()) + " ELSE 'Unknown' END"


@query(f"WITH t AS (SELECT c_custkey AS k, c_custkey % 40 AS l, c_custkey % 3 AS d FROM customer) SELECT k, CAST(l AS INTEGER) AS language, CAST(d AS INTEGER) AS dialect, {_LANGUAGE} AS language_name FROM t")
def language_lookup(spark, sf_dir):
    k = F.col("c_custkey")
    return metadata.with_language(table(spark, sf_dir, "customer").select(k.alias("k"), (k % 40).cast("int").alias("language"), (k % 3).cast("int").alias("dialect")))


def _cue_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cue points of order (file) and part (id), their text entries, and their playlist."""
    item = table(spark, sf_dir, "lineitem")
    cues = item.select(
        F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("cue_point_id"), (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_suppkey")).alias("ordinal"),
        (F.col("l_linenumber").cast("long") * 10**9 + F.col("l_suppkey")).alias("position"), F.lit("data").alias("data_chunk_id"),
    )
    pairs = cues.select("path", "cue_point_id").distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cue_point_id"), "p_name", "p_size")
    null = lambda kind: F.lit(None).cast(kind)
    adtl = pairs.join(part, "cue_point_id").select(
        "path", F.lit(0).cast("long").alias("ordinal"), F.when(F.col("p_size") % 2 == 0, "ltxt").otherwise("labl").alias("kind"), "cue_point_id", F.col("p_name").alias("data"),
        F.col("p_size").cast("long").alias("sample_length"), F.lit("rgn ").alias("purpose_id"), F.col("p_size").cast("int").alias("country"), (F.col("p_size") % 35).cast("int").alias("language"),
        F.lit(1).alias("dialect"), null("int").alias("code_page"), null("bigint").alias("media_type"), null("binary").alias("file_data"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("n"))
    plst = pairs.join(orders, "path").select("path", F.lit(0).cast("long").alias("ordinal"), "cue_point_id", F.col("n").cast("long").alias("num_samples"), F.lit(2).cast("long").alias("repeats"))
    return cues, adtl, plst


@query(
    "WITH cue AS (SELECT l_orderkey AS path, l_partkey AS id, CAST(max(CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS BIGINT) AS start_sample FROM lineitem GROUP BY ALL), "
    "j AS (SELECT c.*, p_name, p_size, p_size AS code, p_size % 35 AS l, 1 AS d, p_size % 2 = 0 AS t, coalesce(o_custkey, 0) AS num_samples, CAST(CASE WHEN o_custkey IS NULL THEN 0 ELSE 2 END AS BIGINT) AS repeats "
    "FROM cue c JOIN part ON id = p_partkey LEFT JOIN orders ON path = o_orderkey) "
    f"SELECT path, id AS cue_point_id, CASE WHEN t THEN '' ELSE p_name END AS label, CAST(p_size AS BIGINT) AS sample_length, CASE WHEN t THEN {_COUNTRY} ELSE '' END AS country, "
    f"CASE WHEN t THEN {_LANGUAGE} ELSE '' END AS language, CASE WHEN t THEN p_name ELSE '' END AS text_data, start_sample, num_samples, repeats FROM j"
)
def cue_full_info(spark, sf_dir):
    full = metadata.full_cue_points(*_cue_tables(spark, sf_dir))
    return full.select("path", "cue_point_id", "label", "sample_length", "country", "language", "text_data", "start_sample", "num_samples", "repeats")


@query("SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations GROUP BY conv_id")
def dedupe_first(spark, sf_dir):
    return metadata.first_wins(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id"], ["turn"]).select("conv_id", "role", "turn")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def dedupe_last(spark, sf_dir):
    return metadata.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query(f"WITH {_SRC} SELECT vec_id AS path, r AS region, count(*) AS n, CAST(sum(xs[i + 1]) AS BIGINT) AS total FROM src, range(64) AS g(i), range(3) AS h(r) WHERE i >= r * 16 AND i < r * 16 + 24 GROUP BY ALL")
def cue_regions(spark, sf_dir):
    """Samples by cue region: a range join."""
    frames = each(waves(spark, sf_dir), i16()).select(F.col("vec_id").alias("path"), F.col("pos").alias("frame_idx"), "sample")
    cues = waves(spark, sf_dir).select(F.col("vec_id").alias("path"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("region"))
    cues = cues.select("path", "region", (F.col("region") * 16).alias("start_sample"), F.lit(24).cast("long").alias("num_samples"))
    return metadata.cue_regions(frames, cues, bucket=16).groupBy("path", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("sample").alias("total"))
