"""Texts and reports that rows are written as."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as T
from .containers import render_markup


def probe_json(tracks: DataFrame, key: str) -> DataFrame:
    """``(key, json)``: tracks in the probe tool's shape, where durations and rates are strings."""
    stream = F.struct(
        F.col("index"), F.coalesce(M.lookup(M.TRACK_TYPES, F.col("kind")), F.lit("data")).alias("codec_type"), M.codec_name(F.col("code")).alias("codec_name"),
        M.probe_seconds(F.col("duration")).alias("duration"), F.col("bitrate").cast("string").alias("bit_rate"),
    )
    got = tracks.groupBy(key).agg(F.array_sort(F.collect_list(stream)).alias("streams"), F.count("*").alias("n"), F.max("duration").alias("d"))
    return got.select(key, F.to_json(F.struct("streams", F.struct(F.col("n").alias("nb_streams"), M.probe_seconds(F.col("d")).alias("duration")).alias("format"))).alias("json"))


def styled(escape: bool) -> Callable[[Column, Column], Column]:
    """A column function of text and style runs: the text with tags around the runs."""

    @F.pandas_udf("string")
    def rendered(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else render_markup(t, [] if r is None else list(r), escape) for t, r in zip(text, runs)], dtype=object)

    return rendered


def _shown(cues: DataFrame, escape: bool) -> Column:
    """The text of cues as it is written: with tags where the cues have runs, escaped where asked."""
    plain = T.escaped(F.col("text")) if escape else F.col("text")
    if "runs" not in cues.columns:
        return plain
    return F.when(F.coalesce(F.size("runs"), F.lit(0)) > 0, styled(escape)(F.col("text"), F.col("runs"))).otherwise(plain)


def _cues(cues: DataFrame, key: str, separator: str, escape: bool) -> DataFrame:
    times = F.concat(T.stamped(F.col("start"), separator), F.lit(" --> "), T.stamped(F.col("end"), separator), F.lit("\n"))
    lines = cues.select(key, "start", "pos", F.concat(times, F.coalesce(_shown(cues, escape), F.lit("")), F.lit("\n\n")).alias("line"))
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "pos", "line"))).alias("rows"))


def subrip(cues: DataFrame, key: str) -> DataFrame:
    """``(key, text)``: numbered cues in order of start and ``pos``, with comma milliseconds and tags for their ``runs``."""
    numbered = F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit("\n"), r["line"]))
    return _cues(cues, key, ",", False).select(key, F.array_join(numbered, "").alias("text"))


def webvtt(cues: DataFrame, key: str) -> DataFrame:
    """``(key, text)``: the header, then cues with dot milliseconds, escaped text and tags for their ``runs``."""
    return _cues(cues, key, ".", True).select(key, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "")).alias("text"))


def json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object with sorted keys per row."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)
