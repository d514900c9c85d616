"""Exposition text: metric lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L

# possessive quantifiers: long escaped values must not recurse in the regex engine
_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})? +(\S+)(?: +-?[0-9]+)?\s*$"
_PAIR_NAME = r'([a-zA-Z_][a-zA-Z0-9_]*)="[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PAIR_VALUE = r'[a-zA-Z_][a-zA-Z0-9_]*="([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, labels, value) of every sample line; comments, blank lines and timestamps are skipped.

    A line that is no sample, or whose value is no number, is an error.
    """
    text = F.col(column)
    rows = lines.where(~F.startswith(F.ltrim(text), F.lit("#")) & (F.trim(text) != ""))
    body = F.regexp_extract(text, _LINE, 2)
    pairs = F.map_from_arrays(
        F.regexp_extract_all(body, F.lit(_PAIR_NAME), F.lit(1)),
        F.transform(F.regexp_extract_all(body, F.lit(_PAIR_VALUE), F.lit(1)), L.unescape),
    )
    number = F.regexp_replace(F.regexp_extract(text, _LINE, 3), r"^([+-]?)Inf$", "$1Infinity")
    value = number.try_cast("double")
    broken = F.raise_error(F.concat(F.lit("not a sample line: "), text))
    name = F.when(text.rlike(_LINE) & value.isNotNull(), F.regexp_extract(text, _LINE, 1)).otherwise(broken)
    return rows.select(name.alias("name"), pairs.alias("labels"), F.coalesce(value, broken.cast("double")).alias("value"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def number_text(value: Column) -> Column:
    """Shortest text of a double without an exponent between 1e-4 and 1e16 (a timestamp is never rounded)."""
    text = value.cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"[-.]", ""), r"0+$", "")
    whole = F.concat(sign, F.rpad(digits, exponent + 1, "0"), F.lit(".0"))
    broken = F.concat(sign, F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when(exponent.between(0, 15) & (F.length(digits) <= exponent + 1), whole)
        .when(exponent.between(0, 15), broken)
        .when(exponent.between(-4, -1), small)
        .otherwise(text)
    )


def sample_line(name: Column, labels: Column, value: Column) -> Column:
    shown = L.render_labels(labels)
    return F.concat(name, F.when(shown == "", F.lit("")).otherwise(F.concat(F.lit("{"), shown, F.lit("}"))), F.lit(" "), number_text(value))


def render(samples: DataFrame, help_text: DataFrame) -> DataFrame:
    """Lines (ord_name, ord_kind, ord_labels, value) of (name, labels, value) with one HELP and TYPE per name.

    ``help_text`` is (name, kind, text). The three leading columns give the output order.
    """
    names = samples.select("name").distinct().join(help_text, "name", "left")
    kind, text = F.coalesce("kind", F.lit("gauge")), F.coalesce("text", F.col("name"))
    heads = names.select(
        F.col("name").alias("ord_name"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("k"), F.concat(F.lit("# HELP "), "name", F.lit(" "), text).alias("v")),
                F.struct(F.lit(1).alias("k"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), kind).alias("v")),
            )
        ).alias("h"),
    ).select("ord_name", F.col("h.k").alias("ord_kind"), F.lit("").alias("ord_labels"), F.col("h.v").alias("value"))
    body = samples.select(
        F.col("name").alias("ord_name"), F.lit(2).alias("ord_kind"), L.render_labels(F.col("labels")).alias("ord_labels"),
        sample_line(F.col("name"), F.col("labels"), F.col("value")).alias("value"),
    )
    return heads.unionByName(body)


def write(lines: DataFrame, path: str) -> None:
    lines.orderBy("ord_name", "ord_kind", "ord_labels").select("value").write.mode("overwrite").text(path)
