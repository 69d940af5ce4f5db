"""Loading delimited lines: sound records typed, faulty lines kept with their reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One field with the comma or the end behind it, from where the last one ended. Possessive, so that matching neither
#: backtracks nor recurses, however long a line is.
FIELD = r'\G(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)(?:,|\z)'
_QUOTED = r'(?s)\A(?:(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+),)*+(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)\z'
_MOMENT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
_AMOUNT = r"\A[0-9]++(?:\.[0-9]++)?+\z"


@dataclass(frozen=True)
class Layout:
    """Fields of a kind of file in their order, and those whose values are judged: moment, moment? or amount."""

    fields: tuple[str, ...]
    judged: dict[str, str]


def _bad(value: Column, rule: str) -> Column:
    v = F.btrim(value, F.lit(" \t"))
    if rule == "amount":
        return ~F.coalesce(v.rlike(_AMOUNT), F.lit(False))
    sound = F.coalesce(v.rlike(_MOMENT), F.lit(False)) & v.try_cast("timestamp_ntz").isNotNull()
    return ~(sound | (F.coalesce(v, F.lit("")) == "")) if rule.endswith("?") else ~sound


def classify_lines(lines: DataFrame, line: str, layout: Layout) -> DataFrame:
    """`lines` with two more columns: record, a struct of the layout's fields as text, and reason, NULL if sound.

    The lines are read permissively under an explicit schema that retains the raw text of corrupt ones. All that the
    reader took or refused is then classed by the strict rules; the first that applies is the reason:
    `quoting` (a double quote that neither encloses a whole field nor is doubled inside one, or isn't closed),
    `column_count` (an empty or NULL line has one field) and `invalid_value`. Line breaks and commas inside quotes
    belong to the field. record is NULL for a faulty line. Columns of `lines` that are called record or reason are
    replaced; all others are kept. Everything is an expression on one row: no shuffle.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in layout.fields] + [T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\u0001", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    text = F.coalesce(F.col(line), F.lit(""))
    quoted = text.contains('"')
    misquoted = quoted & ~text.rlike(_QUOTED)
    # a line without quotes has one field more than commas; else sound fields are counted from end to end
    commas = F.length(text) - F.length(F.replace(text, F.lit(",")))
    count = F.when(quoted, F.regexp_count(text, F.lit(FIELD)) - F.when(text.rlike(r'(?s)[^,]\z'), 1).otherwise(0)).otherwise(commas + 1)
    read = F.from_csv(text, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    fields = F.struct(*[F.col("__read")[f].alias(f) for f in layout.fields])
    bad = F.lit(False)
    for f, rule in layout.judged.items():
        bad = bad | _bad(F.col("__read")[f], rule)
    reason = F.when(misquoted, "quoting").when(F.col("__count") != len(layout.fields), "column_count").when(F.col("__read._corrupt").isNotNull() | bad, "invalid_value")
    classed = lines.withColumns({"__read": read, "__count": count}).withColumn("reason", reason)
    return classed.withColumn("record", F.when(F.col("reason").isNull(), fields)).drop("__read", "__count")
