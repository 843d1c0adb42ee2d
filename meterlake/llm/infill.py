"""Fill-in-middle transformation of texts, cut between units by a sparse checkpoint index.

A unit is a word with the spaces before it, or the spaces that end a text. Counting the units of a
slice of texts records, every EVERY units of a text and at its beginning, the byte and code-point
place reached. A cut behind a text's unit u is found by binary search for the last checkpoint that is
not behind it, and by scanning the few units from there. Counting works in windows of WINDOW bytes, so
that a text of any length needs memory for its checkpoints alone."""

import re
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meterlake.llm import scratch
from meterlake.llm import text as T

#: Units between two checkpoints of a text.
EVERY = 64
#: Bytes that are counted at once.
WINDOW = 1 << 20
#: Fixed values of the result's format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Index(NamedTuple):
    """Of each text, and of the end of the last: units and code points before it in the slice. Of each
    checkpoint, in order: units, bytes and code points before it in the slice."""

    first_unit: np.ndarray
    first_char: np.ndarray
    units: np.ndarray
    bytes: np.ndarray
    chars: np.ndarray


def checkpoints(data: np.ndarray, offsets: np.ndarray, every: int = EVERY, window: int = WINDOW) -> Index:
    """Counts the units of all texts: data has their bytes, offsets where each begins, and the end."""
    n = len(data)
    first_unit, first_char = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
    marks = []
    units = chars = 0
    for a in range(0, n, window):
        b = min(n, a + window)
        space = _SPACE[data[a:b]]
        ends = np.ones(b - a, bool)  # bytes that a space or another text follows
        follow = _SPACE[data[a + 1 : b + 1]]
        ends[: len(follow)] = follow
        text_ends = offsets[1:][(offsets[1:] > a) & (offsets[1:] <= b)] - 1 - a
        last = ends & ~space
        last[text_ends] = True
        place = np.flatnonzero(last)
        points = np.cumsum((data[a:b] & 0xC0) != 0x80)
        begins = np.flatnonzero((offsets >= a) & (offsets < b))
        first_unit[begins] = units + np.searchsorted(place, offsets[begins] - a)
        first_char[begins] = chars + np.concatenate([[0], points])[offsets[begins] - a]
        reached = units + 1 + np.arange(len(place))
        text = np.searchsorted(offsets, place + a, side="right") - 1
        at = (reached - first_unit[text]) % every == 0
        marks.append(np.stack([reached[at], place[at] + a + 1, chars + points[place[at]]]))
        units, chars = units + len(place), chars + int(points[-1])
    behind = offsets >= n
    first_unit[behind], first_char[behind] = units, chars
    marks.append(np.stack([first_unit, offsets, first_char]))
    found = np.concatenate(marks, axis=1)
    found = found[:, np.lexsort((found[1], found[0]))]
    return Index(first_unit, first_char, *found)


def place_of(index: Index, raw: bytes, end: int, unit: int) -> tuple[int, int]:
    """Bytes and code points of the slice before the cut that has unit units before it; raw has the
    slice's bytes, the text with the cut ends at end."""
    k = int(np.searchsorted(index.units, unit, side="right")) - 1
    at, to = int(index.bytes[k]), int(index.bytes[k])
    more = unit - int(index.units[k])
    if more:
        to = next(islice(UNIT.finditer(raw, at, end), more - 1, None)).end()
    skipped = np.frombuffer(raw, np.uint8)[at:to]
    return to, int(index.chars[k]) + int(np.count_nonzero((skipped & 0xC0) != 0x80))


_CUTS = ["n", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars"]


def _cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """n, prefix_bytes, middle_bytes, prefix_chars, middle_chars of each text, cut behind the smaller and
    the larger of first and second, both modulo n + 1."""
    data, offsets = T.utf8(texts)
    index, raw = checkpoints(data, offsets), data.tobytes()
    n = np.diff(index.first_unit)
    one, two = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, two) + index.first_unit[:-1], np.maximum(one, two) + index.first_unit[:-1]
    out = np.zeros((5, len(n)), np.int64)
    out[0] = n
    for i in np.flatnonzero(n):
        a, a_char = place_of(index, raw, int(offsets[i + 1]), int(low[i]))
        b, b_char = place_of(index, raw, int(offsets[i + 1]), int(high[i]))
        out[1:, i] = a - offsets[i], b - a, a_char - index.first_char[i], b_char - a_char
    return out


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _CUTS]))
def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Units of each text, and bytes and code points of its prefix and middle; null texts are empty."""
    rows = pa.RecordBatch.from_arrays([texts, first, second], names=["text", "first", "second"])
    made = [np.zeros((5, 0), np.int64)]
    for part in T.slices(rows, "text"):
        numbers = (part[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "second"))
        made.append(_cuts(part["text"], *numbers))
    whole = np.concatenate(made, axis=1)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in whole], names=_CUTS)


def _holds_mark(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def transformed(df: DataFrame, key: str, text: str, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All columns and n, form, prefix_chars, middle_chars and output.

    Four numbers come from the digest of seed and key: two cut, one decides whether the text is
    transformed (rate percent are), one its form (spm percent of those, the others psm). Texts that hold
    a mark, empty and null ones stay plain, null as an empty output. A null key counts as the empty
    string; rows with one key are cut by the same numbers. Texts of any length are worked on whole; an
    empty table gives no rows; columns that have the names of added ones are replaced."""
    scratch.in_small_batches(df)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    number = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    needed = list(dict.fromkeys([key, text]))
    rows = scratch.packed(df, *needed).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_cut", cuts("_text", number[0], number[1]))
    plain = (F.col("_text") == "") | _holds_mark(F.col("_text")) | (number[2] % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(number[3] % 100 < spm, "spm").otherwise("psm"))
    raw, cut = F.col("_text").cast("binary"), F.col("_cut")
    middle_at = cut["prefix_bytes"] + 1
    suffix_at = middle_at + cut["middle_bytes"]
    part = lambda at, size: F.substring(raw, at.cast("int"), size.cast("int")).cast("string")
    prefix, middle = part(F.lit(1), cut["prefix_bytes"]), part(middle_at, cut["middle_bytes"])
    suffix = part(suffix_at, F.octet_length(raw) - suffix_at + 1)
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(F.col("form") == "plain", F.col("_text"))
    output = output.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
    output = output.otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    added = {"n": cut["n"], "prefix_chars": F.when(moved, cut["prefix_chars"]), "middle_chars": F.when(moved, cut["middle_chars"])}
    rows = rows.withColumns(added | {"output": output})
    return scratch.unpacked(rows, needed, df.columns, "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that transformed() made an output and a form of: no text that was moved holds a mark,
    so the three marks part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents, cut and put together again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = transformed(docs, "doc_id", "text")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    digests = [sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_OP13 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM units),
parts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
cut AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
  FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM cut
"""
