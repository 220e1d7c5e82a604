"""Queries of whole files: metadata chunks, coded files, containers and views.

Every waveform of ``embeddings`` is written as a file with metadata made from
its id, and read back; the SQL computes the same from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.functions import samples, spec
from wavequarry.operators import metadata
from wavequarry.sources import riff, wav

from . import catalogue
from .catalogue import _I16, _SRC, _fold_sql, _read, by_file, query, scratch, spread, table, waves

def _v() -> Column:
    return F.col("vec_id")


def _text(prefix: str, value: Column | None = None) -> Column:
    return F.concat(F.lit(prefix), (_v() if value is None else value).cast("string"))


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def _cue(ident: int, position: Column) -> Column:
    return _struct(cue_point_id=ident, position=position, data_chunk_id="data", chunk_start=0, block_start=0, offset=position)


def _loop(k: Column) -> Column:
    return _struct(identifier=k, type=0, start=k * 4, end=k * 4 + 3, fraction=0, play_count=k)


def _entry(kind: str, ident: int, data: Column, **more) -> Column:
    null = lambda t: F.lit(None).cast(t)
    full = {"sample_length": null("int"), "purpose_id": null("string"), "country": null("int"), "language": null("int"), "dialect": null("int"), "code_page": null("int"), "media_type": null("int"), "file_data": null("binary")} | more
    return _struct(kind=kind, cue_point_id=ident, data=data, **full)


def _meta() -> Column:
    """One struct of all metadata chunks of a file."""
    loops = F.transform(F.sequence(F.lit(1), (_v() % 3 + 1).cast("int")), _loop)
    return _struct(
        slnt=_v() % 1000,
        bext=_struct(description=_text("wave "), originator=_text("o", _v() % 7), originator_ref=_text("ref"), origination_date="2024-01-02", origination_time="03:04:05", time_ref=_v() * 2**32, version=(_v() % 3).cast("int")),
        inst=_struct(base_note=_v() % 128, detune=_v() % 100, gain=_v() % 64, low_note=0, high_note=127, low_velocity=1, high_velocity=_v() % 127),
        smpl=_struct(manufacturer=_v(), product=_v() * 2, sample_period=125000, midi_unity_note=_v() % 128, midi_pitch_fraction=0, smpte_format=0, smpte_offset=0, sampler_data=0, loops=loops),
        acid=_struct(flags=_v() % 8, root_node=60, num_beats=_v() % 16, meter_denominator=4, meter_numerator=3, tempo=F.lit(120.5)),
        trkn=_struct(track_no=_v() % 20, total_tracks=20),
        cues=F.array(_cue(1, _v() % 64), _cue(2, F.lit(7).cast("long"))),
        plst=F.array(_struct(cue_point_id=1, num_samples=_v() % 9 + 1, repeats=2)),
        adtl=F.array(
            _entry("labl", 1, _text("label ")), _entry("note", 1, _text("note ")),
            _entry("ltxt", 2, _text("text "), sample_length=(_v() % 50).cast("int"), purpose_id="rgn ", country=33, language=(_v() % 40).cast("int"), dialect=1, code_page=0),
            _entry("file", 2, F.lit(None).cast("string"), media_type=5, file_data=_text("file ").cast("binary")),
        ),
        info=F.create_map(F.lit("IART"), _text("artist ", _v() % 10), F.lit("INAM"), _text("title "), F.lit("itrk"), (_v() % 20).cast("string")),
        axml=F.concat(_text("<a>"), F.lit("</a>")), ixml=F.concat(_text("<i>"), F.lit("</i>")), id3=_id3(), junk=F.array(_text("junk ").cast("binary"), F.unhex(F.lit("00" * 6))),
    )


def _id3() -> Column:
    """A tag of a title and a track, built from its bytes; every text is shorter than 128 bytes."""

    def frame(name: str, value: Column) -> Column:
        n = F.octet_length(value) + 1
        return F.concat(F.lit(name).cast("binary"), F.unhex(F.lit("000000")), F.unhex(F.lpad(F.hex(n), 2, "0")), F.unhex(F.lit("000003")), value.cast("binary"))

    body = F.concat(frame("TIT2", _text("title ")), frame("TRCK", (_v() % 20).cast("string")))
    return F.concat(F.lit("ID3").cast("binary"), F.unhex(F.lit("040000000000")), F.unhex(F.lpad(F.hex(F.octet_length(body)), 2, "0")), body)


def _tagged_folder(spark, sf_dir) -> str:
    """The folder of the files of all waveforms with their metadata."""
    wav.register(spark)
    folder = scratch(spark)
    content = wav.content_column(F.col("embedding"), 1, "f32", "i16", 8000, meta=_meta(), riff_mode="allow")
    spread(spark, sf_dir).select(F.concat(_v().cast("string"), F.lit(".wav")).alias("path"), content.alias("content")).write.format("wav").mode("append").save(folder)
    return folder


def _tagged(spark, sf_dir, view: str, **options) -> DataFrame:
    """A view of the files of all waveforms with their metadata."""
    return _read(spark, _tagged_folder(spark, sf_dir), view, **options)


# ---- metadata chunks ----


@query("SELECT vec_id, vec_id % 1000 AS slnt FROM embeddings")
def meta_slnt(spark, sf_dir):
    return _tagged(spark, sf_dir, "files").select("vec_id", "slnt")


@query("SELECT vec_id, 'wave ' || vec_id AS description, 'o' || (vec_id % 7) AS originator, 'ref' || vec_id AS originator_ref, '2024-01-02' AS origination_date, '03:04:05' AS origination_time, CAST(vec_id * 4294967296 AS BIGINT) AS time_ref, CAST(vec_id % 3 AS INTEGER) AS version FROM embeddings")
def meta_bext(spark, sf_dir):
    names = ["description", "originator", "originator_ref", "origination_date", "origination_time"]
    return _tagged(spark, sf_dir, "files").select("vec_id", *[F.col(f"bext.{n}").alias(n) for n in names], F.col("bext.time_ref").cast("long").alias("time_ref"), F.col("bext.version").alias("version"))


@query("SELECT vec_id, CAST(vec_id % 128 AS INTEGER) AS base_note, CAST(vec_id % 100 AS INTEGER) AS detune, CAST(vec_id % 64 AS INTEGER) AS gain, 0 AS low_note, 127 AS high_note, 1 AS low_velocity, CAST(vec_id % 127 AS INTEGER) AS high_velocity FROM embeddings")
def meta_inst(spark, sf_dir):
    names = ["base_note", "detune", "gain", "low_note", "high_note", "low_velocity", "high_velocity"]
    return _tagged(spark, sf_dir, "files").select("vec_id", *[F.col(f"inst.{n}").cast("int").alias(n) for n in names])


@query("SELECT vec_id, vec_id AS manufacturer, vec_id * 2 AS product, CAST(125000 AS BIGINT) AS sample_period, vec_id % 128 AS midi_unity_note, CAST(k AS BIGINT) AS identifier, CAST(k * 4 AS BIGINT) AS loop_start, CAST(k * 4 + 3 AS BIGINT) AS loop_end, CAST(k AS BIGINT) AS play_count FROM embeddings, range(1, 4) AS g(k) WHERE k <= vec_id % 3 + 1")
def meta_smpl(spark, sf_dir):
    rows = _tagged(spark, sf_dir, "files").select("vec_id", "smpl.*").withColumn("l", F.explode("loops"))
    return rows.select("vec_id", "manufacturer", "product", "sample_period", "midi_unity_note", F.col("l.identifier").alias("identifier"), F.col("l.start").alias("loop_start"), F.col("l.end").alias("loop_end"), F.col("l.play_count").alias("play_count"))


@query("SELECT vec_id, vec_id % 8 AS flags, 60 AS root_node, vec_id % 16 AS num_beats, 4 AS meter_denominator, 3 AS meter_numerator, CAST(120.5 AS DOUBLE) AS tempo FROM embeddings")
def meta_acid(spark, sf_dir):
    return _tagged(spark, sf_dir, "files").select("vec_id", "acid.*").withColumn("tempo", F.col("tempo").cast("double"))


@query("SELECT vec_id, CAST(vec_id % 20 AS INTEGER) AS track_no, 20 AS total_tracks FROM embeddings")
def meta_trkn(spark, sf_dir):
    return _tagged(spark, sf_dir, "files").select("vec_id", "trkn.*")


@query("SELECT vec_id, 0 AS ordinal, CAST(1 AS BIGINT) AS cue_point_id, vec_id % 64 AS position, 'data' AS data_chunk_id FROM embeddings UNION ALL SELECT vec_id, 1, 2, 7, 'data' FROM embeddings")
def meta_cues(spark, sf_dir):
    return _tagged(spark, sf_dir, "cues").select("vec_id", "ordinal", "cue_point_id", "position", "data_chunk_id")


@query("SELECT vec_id, CAST(1 AS BIGINT) AS cue_point_id, vec_id % 9 + 1 AS num_samples, CAST(2 AS BIGINT) AS repeats FROM embeddings")
def meta_plst(spark, sf_dir):
    return _tagged(spark, sf_dir, "plst").select("vec_id", "cue_point_id", "num_samples", "repeats")


@query(
    "SELECT vec_id, 0 AS ordinal, 'labl' AS kind, CAST(1 AS BIGINT) AS cue_point_id, 'label ' || vec_id AS data, CAST(NULL AS BIGINT) AS sample_length, CAST(NULL AS INTEGER) AS language, CAST(NULL AS VARCHAR) AS file_text FROM embeddings "
    "UNION ALL SELECT vec_id, 1, 'note', 1, 'note ' || vec_id, NULL, NULL, NULL FROM embeddings UNION ALL SELECT vec_id, 2, 'ltxt', 2, 'text ' || vec_id, vec_id % 50, vec_id % 40, NULL FROM embeddings "
    "UNION ALL SELECT vec_id, 3, 'file', 2, NULL, NULL, NULL, 'file ' || vec_id FROM embeddings"
)
def meta_adtl(spark, sf_dir):
    return _tagged(spark, sf_dir, "adtl").select("vec_id", "ordinal", "kind", "cue_point_id", "data", "sample_length", "language", F.col("file_data").cast("string").alias("file_text"))


@query("SELECT vec_id, unnest(['IART', 'INAM', 'itrk', 'ITRK']) AS key, unnest(['artist ' || (vec_id % 10), 'title ' || vec_id, CAST(vec_id % 20 AS VARCHAR), CAST(vec_id % 20 AS VARCHAR)]) AS value FROM embeddings")
def meta_info(spark, sf_dir):
    return _tagged(spark, sf_dir, "info").select("vec_id", "key", "value")


@query("SELECT vec_id, '<a>' || vec_id || '</a>' AS axml, '<i>' || vec_id || '</i>' AS ixml FROM embeddings")
def meta_xml(spark, sf_dir):
    return _tagged(spark, sf_dir, "files").select("vec_id", "axml", "ixml")


@query("SELECT vec_id, unnest([0, 1]) AS ordinal, unnest(['TIT2', 'TRCK']) AS frame, unnest(['title ' || vec_id, CAST(vec_id % 20 AS VARCHAR)]) AS value FROM embeddings")
def meta_id3(spark, sf_dir):
    return _tagged(spark, sf_dir, "id3").select("vec_id", "ordinal", "frame", "value")


@query("SELECT vec_id, 'junk ' || vec_id AS body, CAST(length('junk ' || vec_id) AS BIGINT) AS size, false AS zero FROM embeddings UNION ALL SELECT vec_id, repeat(chr(0), 6), 6, true FROM embeddings")
def meta_junk(spark, sf_dir):
    """All JUNK chunks but the one kept free for a growing container."""
    rows = _tagged(spark, sf_dir, "junk")
    return rows.select("vec_id", F.col("payload").cast("string").alias("body"), "size", spec.all_zero(F.col("payload")).alias("zero"))


_ORDER = ["JUNK", "fmt ", "data", "slnt", "bext", "smpl", "INST", "plst", "cue ", "Trkn", "acid", "LIST", "LIST", "axml", "iXML", "id3 ", "JUNK", "JUNK"]


@query(f"SELECT CAST(unnest(range({len(_ORDER)})) AS INTEGER) AS ordinal, unnest({_ORDER}) AS flag, (SELECT count(*) FROM embeddings) AS n")
def chunk_order(spark, sf_dir):
    """Chunks in the order written: INFO before adtl, then what stands behind the lists."""
    return _tagged(spark, sf_dir, "chunks").groupBy("ordinal", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, CAST(1 AS BIGINT) AS cue_point_id, '' AS label, 'note ' || vec_id AS note, '' AS text_data, vec_id % 64 AS start_sample, vec_id % 9 + 1 AS num_samples, CAST(2 AS BIGINT) AS repeats FROM embeddings UNION ALL SELECT vec_id, 2, '', '', '', 7, 0, 0 FROM embeddings")
def cue_points_of_files(spark, sf_dir):
    """Cue points of files joined with their last text and playlist entries."""
    folder = _tagged_folder(spark, sf_dir)
    views = {v: _read(spark, folder, v).withColumn("path", F.col("vec_id").cast("string")).drop("vec_id") for v in ("cues", "adtl", "plst")}
    full = metadata.full_cue_points(views["cues"], views["adtl"], views["plst"])
    return full.select(F.col("path").cast("long").alias("vec_id"), "cue_point_id", "label", "note", "text_data", "start_sample", "num_samples", "repeats")


_INFO_ROWS = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in metadata.INFO_KEYS.items())


@query(f"SELECT e.key, d.description, count(*) AS n FROM (SELECT unnest(['IART', 'INAM', 'itrk', 'ITRK']) AS key FROM embeddings) e LEFT JOIN (VALUES {_INFO_ROWS}) AS d(key, description) ON e.key = d.key GROUP BY ALL")
def info_describe(spark, sf_dir):
    return metadata.describe_info(_tagged(spark, sf_dir, "info").select("vec_id", "key")).groupBy("key", "description").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, unnest(['IART', 'INAM']) AS key, unnest([source, lang]) AS value FROM documents")
def comments_to_info(spark, sf_dir):
    """Comment fields named as INFO entries; names without one are left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.create_map(F.lit("ARTIST"), F.col("source"), F.lit("TITLE"), F.col("lang"), F.lit("NO SUCH"), F.col("lang"))).alias("comment", "value"))
    return metadata.from_comments(rows).select("doc_id", "key", "value")


# ---- containers and formats ----


def _files(spark, sf_dir, codec: str, view: str, channels: int = 1, read: dict | None = None, **options) -> DataFrame:
    wav.register(spark)
    folder = scratch(spark)
    content = wav.content_column(F.col("embedding"), channels, "f32", codec, 8000, **options)
    spread(spark, sf_dir).select(F.concat(_v().cast("string"), F.lit(".wav")).alias("path"), content.alias("content")).write.format("wav").mode("append").save(folder)
    return _read(spark, folder, view, **(read or {}))


@query("SELECT vec_id, 'RF64' AS container, CAST(64 AS BIGINT) AS total_frames, CAST(256 AS BIGINT) AS data_length, CAST(64 AS BIGINT) AS fact FROM embeddings")
def rf64_files(spark, sf_dir):
    return _files(spark, sf_dir, "f32", "files", riff_mode="force").select("vec_id", "container", "total_frames", "data_length", "fact")


@query("SELECT vec_id, 65534 AS format_tag, 22 AS ext_len, 'extensible' AS ext_kind, CAST(51 AS BIGINT) AS channel_mask, CAST(24 AS BIGINT) AS valid_bits, CAST(16 AS BIGINT) AS total_frames FROM embeddings")
def extensible_files(spark, sf_dir):
    files = _files(spark, sf_dir, "i24", "files", 4, channel_mask=0x33)
    return files.select("vec_id", "fmt.format_tag", "fmt.ext_len", "fmt.ext_kind", "spec.channel_mask", F.col("fmt_ext")["valid_bits_per_sample"].alias("valid_bits"), "total_frames")


_FORMATS = {"i16": (1, None, None, None), "alaw": (6, None, None, 64), "mulaw": (7, None, None, 64), "ms": (2, "adpcm-ms", 2036, 64), "ima": (0x11, "adpcm-ima", 1017, 64), "yamaha": (0x20, None, None, 64), "flac": (0xF1AC, None, None, 64)}
_FORMAT_ROWS = ", ".join(f"('{k}', {t}, {'NULL' if e is None else repr(e)}, {s or 'NULL'}, {n or 'NULL'})" for k, (t, e, s, n) in _FORMATS.items())


@query(f"SELECT vec_id, codec, tag AS format_tag, CAST(kind AS VARCHAR) AS ext_kind, CAST(per_block AS BIGINT) AS samples_per_block, CAST(fact AS BIGINT) AS fact FROM embeddings, (VALUES {_FORMAT_ROWS}) AS f(codec, tag, kind, per_block, fact)")
def format_extensions(spark, sf_dir):
    """Format tags, extension fields and fact chunks of every codec's files."""
    out = None
    for codec in _FORMATS:
        part = _files(spark, sf_dir, codec, "files").select("vec_id", F.lit(codec).alias("codec"), "fmt.format_tag", "fmt.ext_kind", F.col("fmt_ext")["samples_per_block"].alias("samples_per_block"), "fact")
        out = part if out is None else out.unionByName(part)
    return out


#: SQL of each sample's two bytes, low one first.
_BYTES = f"array_to_string(list_transform({_I16}, lambda v: printf('%02x', (v + 65536) % 256) || printf('%02x', ((v + 65536) // 256) % 256)), '')"


def _hash_sql(at: int, n: int) -> str:
    return f"SELECT vec_id, CAST({at} AS BIGINT) AS \"offset\", CAST({n} AS BIGINT) AS length, sha256(unhex(substr({_BYTES}, {2 * at + 1}, {2 * n}))) AS sha256 FROM embeddings"


@query(_hash_sql(0, 128))
def data_hash(spark, sf_dir):
    """The hash of each file's whole data chunk."""
    return _files(spark, sf_dir, "i16", "hash").select("vec_id", "offset", "length", "sha256")


@query(_hash_sql(10, 55))
def data_hash_range(spark, sf_dir):
    """The hash of 55 bytes of each data chunk, from byte 10."""
    return _files(spark, sf_dir, "i16", "hash", read={"hashfrom": 10, "hashlen": 55}).select("vec_id", "offset", "length", "sha256")


@query("SELECT path, error FROM (VALUES ('good.wav', NULL), ('noise.wav', 'not a WAV file'), ('short.wav', 'not a WAV file'), ('tail.wav', NULL)) AS t(path, error)")
def unreadable_files(spark, sf_dir):
    """Files that are no WAV are rows with an error; bytes behind the container's length are not read."""
    wav.register(spark)
    folder = scratch(spark)
    good = wav.content_column(F.col("embedding"), 1, "f32", "i16", 8000)
    one = waves(spark, sf_dir).orderBy("vec_id").limit(1)
    tail = F.lit(riff.chunk_bytes(b"data", b"xx"))
    rows = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ["good.wav", "tail.wav", "noise.wav", "short.wav"])), F.array(good, F.concat(good, tail), F.lit(b"n" * 100), F.lit(b"RIFF")))).alias("path", "content"))
    rows.write.format("wav").mode("overwrite").save(folder)
    files = spark.read.format("wav").option("view", "files").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "error")


# ---- coded files ----

_DECODED = "SELECT vec_id, count(*) AS n, CAST(sum(sample) AS BIGINT) AS total, CAST(sum(sample * (pos % 7 + 1)) AS BIGINT) AS weighted FROM ({}) d GROUP BY vec_id"


def _coded(spark, sf_dir, codec: str, skip: int = 0) -> DataFrame:
    frames = _files(spark, sf_dir, codec, "mono", read={"sampletype": "i16"}).where((F.col("frame_idx") >= skip) & (F.col("frame_idx") < skip + 64))
    value, pos = F.col("sample").cast("long"), F.col("frame_idx") - skip
    return by_file(frames, n=F.count(F.lit(1)), total=F.sum(value), weighted=F.sum(value * (pos % 7 + 1)))


def _coded_query(codec: str, skip: int):
    return lambda spark, sf_dir: _coded(spark, sf_dir, codec, skip)


def _ends_first(sql: str) -> str:
    return _DECODED.format(sql.split(" -- ")[0])


_MS_SRC = f"whole AS (SELECT vec_id, {_I16} AS xs FROM embeddings), src AS (SELECT vec_id, xs[1] AS s_two, xs[2] AS s_one, xs[3:] AS xs FROM whole)"
_MS_FOLD = _fold_sql({"s1": "s_one", "s2": "s_two", "d": 16}, [catalogue._MS_PRED, *catalogue._MS_NIB, *catalogue._MS_TAIL, ["n_s1 AS n_o"]], "sample", _MS_SRC).split(" -- ")[0]
_MS_ALL = f"SELECT vec_id, pos + 2 AS pos, sample FROM ({_MS_FOLD}) m UNION ALL SELECT vec_id, 0, {_I16}[1] FROM embeddings UNION ALL SELECT vec_id, 1, {_I16}[2] FROM embeddings"
#: The codec's frames against SQL that codes and decodes the same samples; IMA gives its header's sample first, MS fills its last block up.
_CODED = {
    "alaw": (catalogue.ORACLE_SQL["alaw_dec"], 0), "mulaw": (catalogue.ORACLE_SQL["mulaw_dec"], 0), "ima": (_fold_sql({"p": 0, "i": 0}, [catalogue._IMA_NIB, *catalogue._IMA_TAIL, ["n_p AS n_o"]], "sample"), 1),
    "ms": (_MS_ALL, 0), "yamaha": (_fold_sql({"p": 0, "s": 127}, [catalogue._YAMAHA_NIB, *catalogue._YAMAHA_TAIL, ["((n_p + 32768) % 65536 + 65536) % 65536 - 32768 AS n_o"]], "sample"), 0),
}
for _codec, (_sql, _skip) in _CODED.items():
    query(_ends_first(_sql), f"{_codec}_files")(_coded_query(_codec, _skip))


#: All frames of the files, the ones that fill up MS's block too.
_MS_FULL = _MS_SRC.replace("xs[3:] AS xs", "list_concat(xs[3:], list_transform(range(2036 - len(xs)), lambda i: xs[len(xs)])) AS xs")
_MS_FULL = _fold_sql({"s1": "s_one", "s2": "s_two", "d": 16}, [catalogue._MS_PRED, *catalogue._MS_NIB, *catalogue._MS_TAIL, ["n_s1 AS n_o"]], "sample", _MS_FULL).split(" -- ")[0]
catalogue.ORACLE_SQL["adpcm_files"] = " UNION ALL ".join(
    f"SELECT vec_id, n, total, '{codec}' AS codec FROM (SELECT vec_id, count(*) + {more} AS n, CAST(sum(sample) AS BIGINT) AS total FROM ({sql.split(' -- ')[0]}) f GROUP BY vec_id) t"
    for codec, more, sql in (("ima", 1, _CODED["ima"][0]), ("yamaha", 0, _CODED["yamaha"][0]), ("ms", 0, f"SELECT vec_id, pos, sample FROM ({_MS_FULL}) m UNION ALL SELECT vec_id, 0, {_I16}[1] + {_I16}[2] FROM embeddings UNION ALL SELECT vec_id, 1, 0 FROM embeddings"))
)


def _seek_query(codec: str, skip: int):
    def run(spark, sf_dir):
        frames = _files(spark, sf_dir, codec, "mono", read={"sampletype": "i16"}).where(F.col("frame_idx") == 17 + skip)
        return frames.select("vec_id", F.col("sample").cast("long").alias("sample"))

    return run


for _codec, (_sql, _skip) in _CODED.items():
    query(f"SELECT vec_id, sample FROM ({_sql.split(' -- ')[0]}) d WHERE pos = 17", f"seek_{_codec}")(_seek_query(_codec, _skip))


# ---- views by channels, and writing one channel to several ----

_PAIR = f"WITH {_SRC} SELECT vec_id, CAST(i AS BIGINT) AS frame_idx, "


@query(_PAIR + "CAST(trunc(CAST(xs[2 * i + 1] + xs[2 * i + 2] AS DOUBLE) / 2) AS BIGINT) AS sample FROM src, range(32) AS g(i)")
def view_mono(spark, sf_dir):
    return _files(spark, sf_dir, "i16", "mono", 2, read={"sampletype": "i16"}).select("vec_id", "frame_idx", F.col("sample").cast("long").alias("sample"))


@query(_PAIR + "xs[i + 1] AS l, xs[i + 1] AS r FROM src, range(64) AS g(i)")
def view_stereo_of_mono(spark, sf_dir):
    return _files(spark, sf_dir, "i16", "stereo", read={"sampletype": "i16"}).select("vec_id", "frame_idx", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


@query(_PAIR + "xs[2 * i + 1] AS l, xs[2 * i + 2] AS r FROM src, range(32) AS g(i)")
def view_stereo(spark, sf_dir):
    return _files(spark, sf_dir, "i16", "stereo", 2, read={"sampletype": "i16"}).select("vec_id", "frame_idx", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


def _limited(x: str) -> str:
    return f"CAST(greatest(least(trunc({x}), 32767), -32768) AS BIGINT)"


_BACK = "(xs[4 * i + {0}] * CAST(0.7071067811865476 AS DOUBLE))"


@query(_PAIR + f"{_limited('xs[4 * i + 1] + ' + _BACK.format(3))} AS l, {_limited('xs[4 * i + 2] + ' + _BACK.format(4))} AS r FROM src, range(16) AS g(i)")
def view_stereo_of_quad(spark, sf_dir):
    """Four channels mixed down by the speakers of their mask."""
    return _files(spark, sf_dir, "i16", "stereo", 4, read={"sampletype": "i16"}, channel_mask=0x33).select("vec_id", "frame_idx", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))


def _written(spark, sf_dir, flat: Column, channels: int) -> DataFrame:
    """Frames of files written from interleaved 16-bit samples."""
    wav.register(spark)
    folder = scratch(spark)
    rows = waves(spark, sf_dir).select(F.concat(_v().cast("string"), F.lit(".wav")).alias("path"), wav.content_column(flat, channels, "i16", "i16", 8000).alias("content"))
    rows.write.format("wav").mode("append").save(folder)
    return _read(spark, folder, "frames", sampletype="i16").select("vec_id", "frame_idx", *[F.col("samples")[c].cast("long").alias("lr"[c]) for c in range(2)])


@query(_PAIR + "xs[i + 1] AS l, xs[i + 1] AS r FROM src, range(64) AS g(i)")
def write_mono(spark, sf_dir):
    """One sample written to both channels."""
    return _written(spark, sf_dir, F.flatten(F.transform(catalogue.i16(), lambda x: F.array(x, x))), 2)


@query(_PAIR + "xs[2 * i + 1] AS l, xs[2 * i + 2] AS r FROM src, range(32) AS g(i)")
def write_stereo(spark, sf_dir):
    """Pairs of left and right written as frames."""
    pairs = F.transform(samples.frames(catalogue.i16(), 2), lambda f: F.struct(f[0].alias("l"), f[1].alias("r")))
    return _written(spark, sf_dir, F.flatten(F.transform(pairs, lambda p: F.array(p["l"], p["r"]))), 2)


@query(_PAIR + "xs[i + 1] AS l, xs[i + 33] AS r FROM src, range(32) AS g(i)")
def write_dual_mono(spark, sf_dir):
    """Two waveforms, here the halves of one, written as the channels of a file."""
    x = catalogue.i16()
    both = F.zip_with(F.slice(x, 1, 32), F.slice(x, 33, 32), lambda a, b: F.array(a, b))
    return _written(spark, sf_dir, F.flatten(both), 2)


# ---- names ----

_TAG_ROWS = ", ".join(f"('{name}', {tag}, '{shown}')" for name, (tag, shown) in spec.PRESETS.items())


@query(f"SELECT preset, format_tag, shown AS format_name FROM (VALUES {_TAG_ROWS}) AS p(preset, format_tag, shown)")
def codec_presets(spark, sf_dir):
    """The sixteen presets, their tags and the names of their formats."""
    rows = spark.createDataFrame([(k,) for k in spec.PRESETS], "preset string")
    return rows.select("preset", spec.preset_tag(F.col("preset")).alias("format_tag"), spec.format_name(spec.preset_tag(F.col("preset"))).alias("format_name"))


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 22127 WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 26447 ELSE 26479 END WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 26448 ELSE 26480 END ELSE CASE WHEN c_custkey % 3 = 0 THEN 26449 ELSE 26481 END END AS tag FROM customer")
def vorbis_tag(spark, sf_dir):
    k = F.col("c_custkey")
    mode = F.element_at(F.array(*map(F.lit, ["naked", "original", "independent", "no_codebook"])), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), spec.vorbis_tag(mode, k % 3 == 0).alias("tag"))


_KINDS = list(spec.SIZES)


@query(f"SELECT c_custkey AS k, {_KINDS}[1 + c_custkey % 12] AS kind, {list(spec.SIZES.values())}[1 + c_custkey % 12] AS bytes FROM customer")
def sample_sizes(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), kind.alias("kind"), spec.sample_bytes(kind).alias("bytes"))


# ---- conversion between every two integer types ----


def _convert_sql(source: str, target: str) -> str:
    a, b = int(source[1:]), int(target[1:])
    x = f"(CAST(c_custkey AS BIGINT) * 2654435761 % {2**a}" + (f" - {2 ** (a - 1)})" if source[0] == "i" else ")")
    signed = x if source[0] == "i" else f"({x} - {2 ** (a - 1)})"
    moved = f"({signed} * {2 ** (b - a)})" if b >= a else f"({signed} >> {a - b})"
    return moved if target[0] == "i" else f"({moved} + {2 ** (b - 1)})"


_PAIRS = [(a, b) for a in ("i8", "i16", "i24", "i32", "u8", "u16", "u24", "u32") for b in ("i8", "i16", "i24", "i32", "u8", "u16", "u24", "u32") if a != b]


@query("SELECT c_custkey AS k, unnest([" + ", ".join(f"'{a} {b}'" for a, b in _PAIRS) + "]) AS pair, unnest([" + ", ".join(f"CAST({_convert_sql(a, b)} AS BIGINT)" for a, b in _PAIRS) + "]) AS value FROM customer")
def scale_integers(spark, sf_dir):
    """Every conversion between two integer types of up to 32 bits."""

    def value(source: str) -> Column:
        a = int(source[1:])
        x = F.col("c_custkey").cast("long") * 2654435761 % 2**a
        return (x - 2 ** (a - 1) if source[0] == "i" else x).cast(samples.SPARK_TYPES[source])

    pairs = [F.struct(F.lit(f"{a} {b}").alias("pair"), samples.scale(value(a), a, b).cast("long").alias("value")) for a, b in _PAIRS]
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*pairs)).alias("p")).select("k", "p.pair", "p.value")


def _floats(kind: str) -> Column:
    return F.col("embedding") if kind == "f32" else F.transform("embedding", lambda x: x.cast("double"))


_ALL = ["i8", "u8", "i16", "u16", "i24", "u24", "i32", "u32"]


@query(
    "SELECT vec_id, unnest([" + ", ".join(f"'{t}'" for t in _ALL) + "]) AS target, unnest(["
    + ", ".join(f"CAST(list_sum(list_transform(embedding, lambda x: CAST(trunc(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * {2 ** (int(t[1:]) - 1) - 1}) AS BIGINT){'' if t[0] == 'i' else f' + {2 ** (int(t[1:]) - 1)}'})) AS BIGINT)" for t in _ALL)
    + "]) AS total FROM embeddings"
)
def scale_doubles(spark, sf_dir):
    """Doubles to every integer type of up to 32 bits, summed."""
    total = lambda t: F.aggregate(samples.scale_all(_floats("f64"), "f64", t), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    rows = F.array(*[F.struct(F.lit(t).alias("target"), total(t).alias("total")) for t in _ALL])
    return waves(spark, sf_dir).select("vec_id", F.explode(rows).alias("p")).select("vec_id", "p.target", "p.total")

