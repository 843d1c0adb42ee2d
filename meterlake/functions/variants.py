"""Strict reading of JSON values: what a number, a time and presence are."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest integer that the logs' writers can hold exactly.
SAFE = 9_007_199_254_740_991


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are made once a row. A filter behind a plain column is pushed below it, and makes
    it anew wherever it names it: a line would be parsed dozens of times."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def json(line: Column) -> Column:
    return F.try_parse_json(line)


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """Spark's name of a variant's type, without parameters."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "(", 1), "<", 1)


def is_object(value: Column) -> Column:
    """Told without the types of all that it holds, which take about as long to write out as to parse."""
    return F.try_variant_get(value, "$", "struct<type:variant>").isNotNull()


def present(value: Column, path: str) -> Column:
    """A JSON null is present."""
    return at(value, path).isNotNull()


def present_null(value: Column, path: str) -> Column:
    return F.coalesce(F.is_variant_null(at(value, path)), F.lit(False))


def text(value: Column, path: str) -> Column:
    """A JSON string; null for anything else, an empty one included only by filled()."""
    part = at(value, path)
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))


def filled(value: Column, path: str) -> Column:
    part = text(value, path)
    return F.when(F.length(part) > 0, part)


def _number(value: Column, path: str) -> Column:
    return F.when(kind(at(value, path)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(value, path, "decimal(38,10)"))


def _whole(number: Column) -> Column:
    return F.when((number == F.floor(number)) & number.between(0, SAFE), number.cast("long"))


def count(value: Column, path: str) -> Column:
    """A JSON number that is a whole, safe, not negative integer; null for anything else."""
    return _whole(_number(value, path))


def counts(df: DataFrame, **columns: tuple[Column, str]) -> DataFrame:
    """Adds count() of each (value, path), made in two steps: a number is read once, and the code of neither
    step is too long for the JVM to compile. It runs methods of over 8,000 bytes of bytecode step by step, some ten
    times as slowly, however often they run."""
    numbers = once(df, **{f"_n_{k}": _number(*x) for k, x in columns.items()})
    return once(numbers, **{k: _whole(F.col(f"_n_{k}")) for k in columns}).drop(*[f"_n_{k}" for k in columns])


def time_ms(value: Column, path: str, number: Column | None = None) -> Column:
    """Milliseconds: a safe integer, or an ISO 8601 string (without an offset: UTC). number: count() of the
    same, where it is made already."""
    stamp = F.try_to_timestamp(text(value, path))
    return F.coalesce(count(value, path) if number is None else number, F.unix_millis(stamp))
