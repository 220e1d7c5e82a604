"""Cue, playlist and text metadata as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Country codes, (language, dialect) codes, INFO keys and their comment names.
COUNTRIES = {
    0: "None (assume 001 = USA)", 1: "USA", 2: "Canada", 3: "Latin America", 30: "Greece", 31: "Netherlands", 32: "Belgium", 33: "France", 34: "Spain", 39: "Italy",
    41: "Switzerland", 43: "Austria", 44: "United Kingdom", 45: "Denmark", 46: "Sweden", 47: "Norway", 49: "West Germany", 52: "Mexico", 55: "Brazil", 61: "Australia",
    64: "New Zealand", 81: "Japan", 82: "Korea", 86: "People’s Republic of China", 88: "Taiwan", 90: "Turkey", 351: "Portugal", 352: "Luxembourg", 354: "Iceland", 358: "Finland",
}
LANGUAGES = {
    (0, 0): "None (assume 9,1 = US English)", (1, 1): "Arabic", (2, 1): "Bulgarian", (3, 1): "Catalan", (4, 1): "Traditional Chinese", (4, 2): "Simplified Chinese",
    (5, 1): "Czech", (6, 1): "Danish", (7, 1): "German", (7, 2): "Swiss German", (8, 1): "Greek", (9, 1): "US English", (9, 2): "UK English", (10, 1): "Spanish", (10, 2): "Spanish",
    (11, 1): "Finnish", (12, 1): "French", (12, 2): "Belgian French", (12, 3): "Canadian French", (12, 4): "Swiss French", (13, 1): "Hebrew", (14, 1): "Hungarian",
    (15, 1): "Icelandic", (16, 1): "Italian", (16, 2): "Swiss Italian", (17, 1): "Japanese", (18, 1): "Korean", (19, 1): "Dutch", (19, 2): "Belgian Dutch",
    (20, 1): "Norwegian - Bokmal", (20, 2): "Norwegian - Nynorsk", (21, 1): "Polish", (22, 1): "Brazilian Portuguese", (22, 2): "Portuguese", (23, 1): "Rhaeto-Romanic",
    (24, 1): "Romanian", (25, 1): "Russian", (26, 1): "Serbo-Croatian (Latin)", (26, 2): "Serbo-Croatian (Cyrillic)", (27, 1): "Slovak", (28, 1): "Albanian",
    (29, 1): "Swedish", (30, 1): "Thai", (31, 1): "Turkish", (32, 1): "Urdu", (33, 1): "Bahasa",
}
INFO_KEYS = {
    "IARL": "The location where the subject of the file is archived", "IART": "The artist of the original subject of the file",
    "ICMS": "The name of the person or organization that commissioned the original subject of the file", "ICMT": "General comments about the file or its subject",
    "ICOP": "Copyright information about the file (e.g., \"Copyright Some Company 2011\")",
    "ICRD": "The date the subject of the file was created (creation date) (e.g., \"2022-12-31\")", "ICRP": "Whether and how an image was cropped",
    "IDIM": "The dimensions of the original subject of the file", "IDPI": "Dots per inch settings used to digitize the file", "IENG": "The name of the engineer who worked on the file",
    "IGNR": "The genre of the subject", "IKEY": "A list of keywords for the file or its subject", "ILGT": "Lightness settings used to digitize the file",
    "IMED": "Medium for the original subject of the file", "INAM": "Title of the subject of the file (name)",
    "IPLT": "The number of colors in the color palette used to digitize the file", "IPRD": "Name of the title the subject was originally intended for",
    "ISBJ": "Description of the contents of the file (subject)", "ISFT": "Name of the software package used to create the file",
    "ISRC": "The name of the person or organization that supplied the original subject of the file",
    "ISRF": "The original form of the material that was digitized (source form)", "ITCH": "The name of the technician who digitized the subject file", "ITRK": "The track number of the file",
}
COMMENTS = {
    "ITRK": "TRACKNUMBER", "IART": "ARTIST", "INAM": "TITLE", "IPRD": "ALBUM", "ICMT": "COMMENT", "ICOP": "COPYRIGHT", "ICRD": "DATE",
    "IGNR": "GENRE", "ISRC": "ISRC", "ISFT": "ENCODER", "ISMP": "TIMECODE", "ILNG": "LANGUAGE", "ICMS": "PRODUCER",
}


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def countries(spark: SparkSession) -> DataFrame:
    return _rows(spark, list(COUNTRIES.items()), "country int, country_name string")


def languages(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(a, b, n) for (a, b), n in LANGUAGES.items()], "language int, dialect int, language_name string")


def with_country(df: DataFrame, code: str = "country") -> DataFrame:
    """``country_name`` of a code: a 30-row broadcast; a miss names the code."""
    dim = F.broadcast(countries(df.sparkSession).withColumnRenamed("country", "_code"))
    joined = df.join(dim, F.col(code) == F.col("_code"), "left").drop("_code")
    return joined.withColumn("country_name", F.coalesce("country_name", F.concat(F.lit("Unknown country code "), F.col(code).cast("string"))))


def with_language(df: DataFrame, language: str = "language", dialect: str = "dialect") -> DataFrame:
    """``language_name`` of a pair of codes; a miss is ``Unknown``."""
    dim = F.broadcast(languages(df.sparkSession).toDF("_l", "_d", "language_name"))
    joined = df.join(dim, (F.col(language) == F.col("_l")) & (F.col(dialect) == F.col("_d")), "left").drop("_l", "_d")
    return joined.withColumn("language_name", F.coalesce("language_name", F.lit("Unknown")))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])


def full_cue_points(cues: DataFrame, adtl: DataFrame, plst: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Cue points with their text and playlist entries, one row per (path, cue_point_id).

    The last of repeated ids wins on every side.  A cue without a playlist
    entry has no samples and no repeats; one without a text entry is an error
    in strict mode and is left out otherwise.
    """
    keys = ["path", "cue_point_id"]
    cue = last_wins(cues, keys, ["ordinal"]).drop("ordinal")
    text = last_wins(adtl, keys, ["ordinal"]).drop("ordinal").withColumn("_text", F.lit(True))
    if plst is None:
        played = cue.withColumn("num_samples", F.lit(0).cast("long")).withColumn("repeats", F.lit(0).cast("long"))
    else:
        played = cue.join(last_wins(plst, keys, ["ordinal"]).drop("ordinal"), keys, "left").fillna(0, ["num_samples", "repeats"])
    out = played.join(text, keys, "left")
    if strict:
        found = F.when(F.col("_text").isNull(), F.raise_error(F.concat(F.lit("no text entry for cue point "), F.col("cue_point_id").cast("string"))).cast("boolean")).otherwise(True)
        out = out.where(found)
    else:
        out = out.where("_text")
    out = with_language(with_country(out))
    is_text = F.col("kind") == "ltxt"
    return out.select(
        *keys, "data_chunk_id", F.when(F.col("kind") == "labl", F.col("data")).otherwise("").alias("label"), F.when(F.col("kind") == "note", F.col("data")).otherwise("").alias("note"),
        F.coalesce("sample_length", F.lit(0).cast("long")).alias("sample_length"), F.coalesce("purpose_id", F.lit("")).alias("purpose_id"),
        F.when(is_text, F.col("country_name")).otherwise("").alias("country"), F.when(is_text, F.col("language_name")).otherwise("").alias("language"),
        F.when(is_text, F.col("data")).otherwise("").alias("text_data"), F.coalesce("media_type", F.lit(0).cast("long")).alias("media_type"), "file_data",
        F.col("position").alias("start_sample"), "num_samples", "repeats",
    )


def upper_fill(info: Column) -> Column:
    """INFO entries; a lower-case key also fills its upper-case form where that is absent."""
    absent = F.map_filter(info, lambda k, _: (F.upper(k) != k) & ~F.map_contains_key(info, F.upper(k)))
    return F.map_concat(info, F.map_from_entries(F.transform(F.map_entries(absent), lambda e: F.struct(F.upper(e["key"]), e["value"]))))


def info_in_order(info: Column) -> Column:
    return F.array_sort(F.map_entries(info))


def to_comments(info: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose INFO key has a comment name, with that name: a 13-row broadcast."""
    dim = F.broadcast(_rows(info.sparkSession, list(COMMENTS.items()), "_key string, comment string"))
    return info.join(dim, F.col(key) == F.col("_key")).drop("_key")


def from_comments(rows: DataFrame, comment: str = "comment") -> DataFrame:
    dim = F.broadcast(_rows(rows.sparkSession, [(v, k) for k, v in COMMENTS.items()], "_comment string, key string"))
    return rows.join(dim, F.col(comment) == F.col("_comment")).drop("_comment")


def describe_info(info: DataFrame, key: str = "key") -> DataFrame:
    """Rows with the meaning of their INFO key, null where it is not known."""
    dim = F.broadcast(_rows(info.sparkSession, list(INFO_KEYS.items()), "_key string, description string"))
    return info.join(dim, F.col(key) == F.col("_key"), "left").drop("_key")


def cue_regions(frames: DataFrame, cues: DataFrame, bucket: int = 4096) -> DataFrame:
    """Frames in cue regions [start, start + num_samples): a range join by buckets of frames."""
    last = F.col("start_sample") + F.col("num_samples") - 1
    spread = cues.where("num_samples > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_sample") / bucket), F.floor(last / bucket))))
    keyed = frames.withColumn("_bucket", F.floor(F.col("frame_idx") / bucket))
    joined = keyed.join(spread, ["path", "_bucket"]).where((F.col("frame_idx") >= F.col("start_sample")) & (F.col("frame_idx") <= last))
    return joined.drop("_bucket")
