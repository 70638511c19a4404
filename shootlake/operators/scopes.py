"""Scopes: level histograms and waveforms of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shootlake.functions import colour as K

CHANNELS = ("r", "g", "b")


def _levels(px: DataFrame) -> DataFrame:
    """One row per pixel and channel with its 8-bit level."""
    return px.select("image_id", "y", "x", F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), K.quantised(F.col(c)).alias("v")) for c in CHANNELS])).alias("s")).select(
        "image_id", "y", "x", "s.channel", "s.v")


def histogram(px: DataFrame, bins: int = 64) -> DataFrame:
    """Counts per frame, channel and bin, empty bins included. Counts combine map-side."""
    counts = _levels(px).groupBy("image_id", "channel", F.floor(F.col("v") * bins / 256).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    # at most 3 x bins rows per frame meet here, never its pixels
    full = counts.groupBy("image_id", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return full.select("image_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "m").select(
        "image_id", "channel", "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).alias("n"))


def waveform(px: DataFrame, frames: DataFrame, columns: int = 256, levels: int = 128) -> DataFrame:
    """Trace counts per frame, channel, row (0 brightest) and column; cells without a trace are absent."""
    sized = _levels(px).join(frames.select("image_id", "width"), "image_id")
    return sized.groupBy("image_id", "channel", (F.lit(levels - 1) - F.floor(F.col("v") * levels / 256)).cast("int").alias("row"),
                         F.floor(F.col("x") * columns / F.col("width")).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("n"))


def shade(trace: DataFrame, frames: DataFrame, columns: int = 256) -> DataFrame:
    """Brightness 0..255 of each waveform cell, against the lesser of the peak and a flat trace's count."""
    peaks = trace.groupBy("image_id", "channel").agg(F.max("n").alias("_peak"))
    sized = trace.join(peaks, ["image_id", "channel"]).join(frames.select("image_id", "width", "height"), "image_id")
    flat = F.greatest(F.lit(1.0), F.col("height") * F.col("width") / columns / 8)
    limit = F.greatest(F.lit(1.0), F.least(F.col("_peak").cast("double"), flat))
    shadeof = F.floor(F.pow(F.least(F.lit(1.0), F.col("n") / limit), F.lit(0.6)) * 255 + 0.5).cast("int")
    return sized.select(*trace.columns, shadeof.alias("shade"))
