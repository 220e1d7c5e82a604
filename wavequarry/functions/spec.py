"""Format arithmetic and names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaker bits in mask order, default masks by channel count, rates and tables.
SPEAKERS = [
    "front_left", "front_right", "front_center", "low_freq", "back_left", "back_right", "front_left_of_center", "front_right_of_center", "back_center",
    "side_left", "side_right", "top_center", "top_front_left", "top_front_center", "top_front_right", "top_back_left", "top_back_center", "top_back_right",
]
DEFAULT_MASKS = {1: 0x4, 2: 0x3, 3: 0x7, 4: 0x33, 5: 0x37, 6: 0x60F, 7: 0x70F, 8: 0x63F}
OPUS_RATES = [8000, 12000, 16000, 24000, 48000]
OPUS_BLOCKS_10MS = [25, 50, 100, 200, 400, 600]
VORBIS_BITRATES = {
    (48000, 1): [64000, 80000, 96000, 112000, 128000, 160000, 192000, 240000, 256000, 350000, 450000],
    (48000, 2): [48000, 64000, 72000, 80000, 88000, 96000, 112000, 128000, 144000, 192000, 256000],
    (44100, 1): [64000, 80000, 96000, 112000, 128000, 160000, 192000, 240000, 256000, 350000, 450000],
    (44100, 2): [48000, 64000, 72000, 80000, 88000, 96000, 112000, 128000, 144000, 192000, 256000],
    (22050, 1): [56000, 72000, 80000, 88000, 96000, 112000, 144000, 176000, 192000, 256000, 320000],
    (22050, 2): [36000, 42000, 48000, 52000, 56000, 64000, 80000, 88000, 96000, 128000, 168000],
    (11025, 1): [36000, 44000, 50000, 52000, 56000, 64000, 80000, 96000, 112000, 144000, 168000],
    (11025, 2): [22000, 26000, 28000, 30000, 32000, 34000, 40000, 48000, 56000, 72000, 88000],
}
#: Preset -> (format tag, name of its format).
PRESETS = {
    "pcm": (0x0001, "PCM"), "pcm-alaw": (0x0006, "PCM-ALaw"), "pcm-ulaw": (0x0007, "PCM-MuLaw"), "adpcm-ms": (0x0002, "ADPCM-MS"), "adpcm-ima": (0x0011, "ADPCM-IMA"), "adpcm-yamaha": (0x0020, "ADPCM-YAMAHA"),
    "mp3": (0x0055, "MP3"), "opus": (0x704F, "Opus"), "flac": (0xF1AC, "Flac"), "vorbis": (0x566F, "OggVorbis"), "oggvorbis1": (0x674F, "OggVorbis"), "oggvorbis2": (0x6750, "OggVorbis"), "oggvorbis3": (0x6751, "OggVorbis"),
    "oggvorbis1p": (0x676F, "OggVorbis"), "oggvorbis2p": (0x6770, "OggVorbis"), "oggvorbis3p": (0x6771, "OggVorbis"),
}
SIZES = {"S8": 1, "S16": 2, "S24": 3, "S32": 4, "S64": 8, "U8": 1, "U16": 2, "U24": 3, "U32": 4, "U64": 8, "F32": 4, "F64": 8}


def _choose(cases: dict, key: Column, default) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def sample_type(bits: Column, sample_format: Column) -> Column:
    """The storable type of (bits, format): ``Unknown`` for any other pair."""
    known = {"8 UInt": "U8", "16 Int": "S16", "24 Int": "S24", "32 Int": "S32", "64 Int": "S64", "32 Float": "F32", "64 Float": "F64"}
    return _choose(known, F.concat_ws(" ", bits.cast("string"), sample_format), "Unknown")


def sample_format(tag: Column, bits: Column, guid_kind: Column) -> Column:
    """UInt, Int, Float or Unknown from tag, bits and the kind of an extension GUID (null: no extension)."""
    whole = (tag.isin(1, 0xFFFE) & bits.isin(16, 24)) | ((tag == 1) & bits.isin(32, 64))
    wide = (tag == 0xFFFE) & bits.isin(32, 64)
    return (
        F.when(tag.isin(1, 0xFFFE) & (bits == 8), "UInt").when(whole, "Int")
        .when(wide & guid_kind.isNull(), "Int").when(wide & (guid_kind == "pcm"), "Int").when(wide & (guid_kind == "float"), "Float")
        .when((tag == 3) & bits.isin(32, 64), "Float").otherwise("Unknown")
    )


def preset_tag(preset: Column) -> Column:
    """The format tag of a preset's name, null for any other."""
    return _choose({k: tag for k, (tag, _) in PRESETS.items()}, preset, F.lit(None).cast("int"))


def format_name(tag: Column) -> Column:
    """The name of a tag's format; ``Unspecified`` for tags of no preset."""
    return _choose(dict(PRESETS.values()), tag, "Unspecified")


def vorbis_tag(mode: Column, variable: Column) -> Column:
    """The tag of a Vorbis stream: by what its file holds of the headers, and whether its bitrate varies."""
    out = F.when(mode == "naked", 0x566F)
    for k, name in enumerate(("original", "independent", "no_codebook"), 1):
        out = out.when(mode == name, F.when(variable, 0x674E + k).otherwise(0x676E + k))
    return out


def sample_bytes(kind: Column) -> Column:
    return _choose(SIZES, kind, 0)


def guess_mask(channels: Column) -> Column:
    """The default speaker mask of 1 to 8 channels, null beyond."""
    return _choose(DEFAULT_MASKS, channels, F.lit(None).cast("int"))


def mask_positions(mask: Column) -> Column:
    """The speaker bits of a mask."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda b: F.when(F.getbit(mask.cast("long"), b) == 1, F.pow(F.lit(2.0), b).cast("long"))), lambda v: v.isNotNull())


def mask_names(mask: Column) -> Column:
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda b: F.when(F.getbit(mask.cast("long"), b) == 1, F.element_at(F.array(*map(F.lit, SPEAKERS)), b + 1))), lambda v: v.isNotNull())


def mask_is_valid(mask: Column, channels: Column) -> Column:
    return F.bit_count(mask) == channels


def align(size: Column) -> Column:
    """Chunks are aligned to two bytes."""
    return size + size % 2


def pcm_block_align(channels: Column, bits: Column) -> Column:
    return channels * F.floor(bits / 8)


def pcm_byte_rate(rate: Column, channels: Column, bits: Column) -> Column:
    return rate.cast("long") * pcm_block_align(channels, bits)


def mp3_block_size(bitrate: Column, rate: Column) -> Column:
    """Bytes of a frame, as an unsigned 16-bit number."""
    return (F.floor(144 * bitrate / rate) % 65536).cast("int")


def mp3_granule(rate: Column) -> Column:
    return F.when(rate <= 28000, 576).otherwise(1152)


def opus_rate(rate: Column) -> Column:
    """The next rate that Opus knows; the largest for all above."""
    out = F.lit(OPUS_RATES[-1])
    for r in reversed(OPUS_RATES):
        out = F.when(rate <= r, F.lit(r)).otherwise(out)
    return out


def opus_block(rate: Column, channels: Column, tenths_of_ms: int) -> Column:
    return F.floor(rate.cast("long") * tenths_of_ms * channels / 10000)


def fft_size(source: Column, target: Column) -> Column:
    """The next power of two at or above the larger rate."""
    top = F.greatest(source, target)
    out = F.lit(1 << 30)
    for k in range(29, -1, -1):
        out = F.when(top <= 1 << k, F.lit(1 << k)).otherwise(out)
    return out


def process_size(source: Column, target: Column) -> Column:
    return F.floor(fft_size(source, target).cast("long") * source / F.greatest(source, target))


def measured_bitrate(data_bytes: Column, rate: Column, n_frames: Column) -> Column:
    return F.when(n_frames > 0, F.floor(data_bytes * 8 * rate / n_frames))


def vorbis_bitrate(rate: Column, channels: Column, quality: Column) -> Column:
    """Nominal bitrate of quality 0 to 1; null for a rate or channel count without a table."""
    at = F.greatest(F.least(F.floor(quality * 10), F.lit(10)), F.lit(0)).cast("int") + 1
    out = F.lit(None).cast("int")
    for (r, c), table in VORBIS_BITRATES.items():
        out = F.when((rate == r) & (channels == c), F.element_at(F.array(*map(F.lit, table)), at)).otherwise(out)
    return out


def adpcm_layout(kind: str, channels: Column, rate: Column) -> dict[str, Column]:
    """block_align, samples_per_block and byte_rate of an ADPCM kind."""
    if kind == "yamaha":
        return {"block_align": F.lit(1024).cast("long"), "samples_per_block": F.floor(F.lit(2048) / channels), "byte_rate": F.floor(rate * channels / 2)}
    block, samples = (512, 1017) if kind == "ima" else (1024, 2036)
    return {"block_align": (channels * block).cast("long"), "samples_per_block": F.lit(samples).cast("long"), "byte_rate": F.floor(rate.cast("long") * channels * block / samples)}


def little_endian(data: Column, size: int) -> Column:
    """The unsigned integer of the first ``size`` bytes, at most seven."""
    h = F.hex(data)
    return F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in range(size - 1, -1, -1)]), 16, 10).cast("long")


def guid_text(data: Column) -> Column:
    """The text of a 16-byte GUID, first three fields little-endian."""
    h = F.upper(F.hex(data))

    def swap(begin: int, n: int) -> Column:
        return F.concat(*[F.substring(h, 2 * (begin + n - 1 - k) + 1, 2) for k in range(n)])

    return F.concat_ws("-", swap(0, 4), swap(4, 2), swap(6, 2), F.substring(h, 17, 4), F.substring(h, 21, 12))


def all_zero(data: Column) -> Column:
    """Whether every byte is zero; true for none."""
    return F.hex(data).rlike("^(00)*$")


def track_number(text: Column) -> Column:
    """An unsigned 32-bit track number, null for anything else."""
    n = text.try_cast("long")
    return F.when((n >= 0) & (n < 1 << 32) & text.rlike(r"^\+?[0-9]+$"), n)


def zero_terminated(text: Column) -> Column:
    return F.when(F.endswith(text, F.lit("\0")), text).otherwise(F.concat(text, F.lit("\0")))
