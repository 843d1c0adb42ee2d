"""Tables as CSV and JSON, and the cache report as text."""

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from meterlake.functions import labels
from meterlake.operators.cache_window import BANDS, EXCLUSIONS


def write_csv(df: DataFrame, path: str, order: list | None = None, one_file: bool = False) -> None:
    """RFC 4180 with a header and minimal quoting. one_file: for reports, that are small."""
    df = df.orderBy(*order) if order else df
    df = df.coalesce(1) if one_file else df
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def csv_lines(df: DataFrame) -> DataFrame:
    """The rows as CSV text, one column line; null is empty."""
    fields = [F.coalesce(labels.csv_field(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    return df.select(F.concat_ws(",", *fields).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))


def cache_report(row: Row, bands: list[Row], sensitivity: list[Row]) -> str:
    """Markdown of cache_window.analyze, gap_bands and sensitivity, whose sizes are fixed."""
    minutes = lambda ms: "—" if ms is None else f"{ms / 60_000:.2f}"
    out = ["# Cache inactivity window", "", f"- Calls: {row.calls:,} in {row.streams:,} streams", f"- Transitions: {row.transitions:,}; hits {row.hits:,}, misses {row.misses:,}, ambiguous {row.ambiguous:,}", f"- Longest run of hits: {minutes(row.run_ms)} min, {row.run_length:,} transitions", f"- Median cached tokens after a miss: {'—' if row.cache_read_after_miss_median is None else f'{row.cache_read_after_miss_median:,.0f}'}", "", "| scope | last hit (min) | first miss (min) | estimate (min) | before: hits, misses | after: hits, misses |", "| --- | --- | --- | --- | --- | --- |"]
    for name in ("all", "account_idle", "session_idle"):
        p = row[f"{name}_change_point"]
        out.append(f"| {name} | none | | | | |" if p is None else f"| {name} | {minutes(p.lower_ms)} | {minutes(p.upper_ms)} | {minutes(p.estimated_ms)} | {p.before_hits}, {p.before_misses} | {p.after_hits}, {p.after_misses} |")
    found = {b.label: b for b in bands}
    out += ["", "| gap | hits | misses |", "| --- | --- | --- |", *[f"| {label} | {found[label].hits} | {found[label].misses} |" for label, _, _ in BANDS]]
    out += ["", "| excluded because | transitions |", "| --- | --- |", *[f"| {r} | {row[r]} |" for r in EXCLUSIONS]]
    out += ["", "| least prefix | last hit (min) | first miss (min) |", "| --- | --- | --- |", *[f"| {s.min_cache_read:,} | {minutes(s.lower_ms)} | {minutes(s.upper_ms)} |" for s in sensitivity]]
    return "\n".join(out) + "\n"
