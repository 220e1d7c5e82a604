"""Streams of WAV files and codec state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavequarry.functions.adpcm import Yamaha


def wav_file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of WAV files as they arrive."""
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.wav").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )


def yamaha_decode_stream(blocks: DataFrame) -> DataFrame:
    """(path, block_idx, samples) of mono Yamaha payloads (path, block_idx, payload).

    The codec's state runs through the whole file, so it is kept for each
    path between micro-batches; a file's blocks must arrive in order, and an
    empty payload ends the file and drops its state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        codec = Yamaha(*state.get) if state.exists else Yamaha()
        rows, ended = [], False
        for part in sorted((r for p in parts for r in p.itertuples(index=False)), key=lambda r: r.block_idx):
            payload = bytes(part.payload)
            ended = not payload
            rows.append((key[0], part.block_idx, [codec.expand(n) for b in payload for n in (b & 15, b >> 4)]))
        if ended:
            state.remove()
        else:
            state.update((codec.p, codec.s))
        yield pd.DataFrame(rows, columns=["path", "block_idx", "samples"])

    return blocks.groupBy("path").applyInPandasWithState(step, "path string, block_idx long, samples array<int>", "p long, s long", "append", GroupStateTimeout.NoTimeout)
