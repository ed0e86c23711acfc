"""Outputs: report rows and HTML, summary table, plot data, WAV files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import lights
from .audio import encode_wav


def case_number(ts: Column) -> Column:
    """From the case's own time, so that a report can be made again."""
    return F.concat(F.lit("VM-"), F.date_format(ts, "yyyyMMddHHmmss"))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)


def summary_rows(summary: DataFrame) -> DataFrame:
    """Metric rows with their lights; expects median, ci_lo, ci_hi and the case's consistency."""
    return summary.withColumns(lights(F.col("ci_hi") - F.col("ci_lo"), F.col("median"), F.col("consistency")))


def markdown_row(metric: str = "metric") -> Column:
    return F.format_string("| %s | %.4f | %.4f | %d | %d |", F.col(metric), F.col("median"), F.col("mean"), F.col("n"), F.col("n_high"))


def _section(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(f'<section id="{name}">'), *parts, F.lit("</section>"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))


def html_reports(cases: DataFrame, metrics: DataFrame, on: str = "pair_id") -> DataFrame:
    """One HTML report a case, in six sections: objects, authenticity, results by metric (in their order of name) with
    their consistency, score, verdict with warnings, images (left out where there are none).

    ``cases``: on, case_ts, final_score, consistency, verdict_code, warning_codes, objects and images (arrays of names),
    modification (null where none was found). ``metrics``: on, metric, median, ci_lo, ci_hi, n, n_high. A row's class
    follows the width of its interval, the verdict's the score alone.
    """
    width = F.col("ci_hi") - F.col("ci_lo")
    css = F.when(width < 0.1, "success").when(width < 0.2, "info").otherwise("warning")
    row = F.format_string("<tr class=\"%s\"><td>%s</td><td>%s</td><td>%s - %s</td><td>%d/%d</td></tr>", css, F.col("metric"), _percent(F.col("median")), _percent(F.col("ci_lo")), _percent(F.col("ci_hi")), F.col("n_high"), F.col("n"))
    table = metrics.groupBy(on).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    score, lit = F.col("final_score"), F.lit
    look = F.when(score >= 0.88, "success").when(score >= 0.7, "info").otherwise("warning")
    steady = F.when(F.col("consistency") < 0.1, "high").when(F.col("consistency") < 0.15, "medium").otherwise("low")
    boxed = lambda c: F.concat(lit('<div class="'), look, lit('">'), c, lit("</div>"))
    found = F.when(F.col("modification").isNull(), '<div class="success">authentic</div>').otherwise(F.concat(lit('<div class="warning">'), F.col("modification"), lit("</div>")))
    page = F.concat(
        lit("<html><body><h1>"), case_number(F.col("case_ts")), lit("</h1>"),
        _section("objects", _list(F.col("objects"))),
        _section("authenticity", found),
        _section("results", lit("<table>"), F.coalesce("rows", lit("")), lit("</table><p>consistency: "), steady, lit("</p>")),
        _section("score", boxed(_percent(score))),
        _section("verdict", boxed(F.col("verdict_code")), _list(F.col("warning_codes"))),
        F.when(F.size("images") > 0, _section("images", _list(F.col("images")))).otherwise(""),
        lit("</body></html>"),
    )
    return cases.join(table, on, "left").select(on, page.alias("html"))


def plot_data(frames: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Long table (by, ts, series, y) for charts."""
    return frames.select(*by, "ts", F.explode(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("y")) for c in columns])).alias("s")).select(*by, "ts", "s.*").where("y is not null")


def difference_bars(a: DataFrame, b: DataFrame, on: list[str], spans: dict[str, float]) -> DataFrame:
    """Differences over their spans, at most 1, with the guide lines at 0.3 and 0.7 as codes."""
    j = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in spans]).join(b.select(*on, *[F.col(c).alias(f"{c}_b") for c in spans]), on)
    bars = F.array(*[F.struct(F.lit(c).alias("feature"), F.least(F.lit(1.0), F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) / F.lit(s)).alias("difference")) for c, s in spans.items()])
    d = F.col("difference")
    return j.select(*on, F.explode(bars).alias("s")).select(*on, "s.*").withColumn("level", F.when(d < 0.3, "low").when(d < 0.7, "medium").otherwise("high"))


def wav_rows(segments: DataFrame, keys: list[str], amp: str = "amp") -> DataFrame:
    """Segments as WAV bytes; write them with any binary sink, or keep them as a column."""

    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return x.map(lambda a: encode_wav(np.asarray(a, dtype=float)))

    return segments.select(*keys, encode(amp).alias("wav"))


def spectral_plot_data(spectrum: DataFrame, by: list[str], t: str, step_s: float, cepstra: DataFrame | None = None) -> DataFrame:
    """Rows (by, series, ts, bin, y) of a spectrogram in dB against the recording's largest magnitude, and of the
    ``cepstra`` (by, t, coefficient, value) where they are given."""
    from ..operators.signal import decibels

    power = spectrum.select(*by, t, "bin", (F.col("mag").cast("double") * F.col("mag")).alias("_p"))
    ts = (F.col(t) * F.lit(float(step_s))).alias("ts")
    out = decibels(power, by, "_p").select(*by, F.lit("stft_db").alias("series"), ts, "bin", F.col("db").alias("y"))
    if cepstra is None:
        return out
    return out.union(cepstra.select(*by, F.lit("mfcc"), ts, F.col("coefficient").cast("int"), "value"))
