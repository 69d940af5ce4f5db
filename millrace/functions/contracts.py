"""Values out of loosely written text: JSON within prose, message contracts, captures, digests, forms of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months that end a report's period, and the codes of their reports.
REPORT_CODES = {"03": "11013", "06": "11012", "09": "11014", "12": "11011"}
CORRECTIONS = ("정정", "철회")


def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace, as JSON; NULL if it is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def whole_number(value: Column, path: str, low: int, high: int) -> Column:
    """A whole number of a JSON value within bounds; NULL for fractions, booleans and texts."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    n = F.try_variant_get(value, path, "bigint")
    return F.when((kind == "BIGINT") & n.between(low, high), n.cast("int"))


def two_scores(text: Column, low: int = 1, high: int = 5) -> Column:
    """struct(x, y) of a judge's scores; NULL unless both are whole numbers within bounds."""
    v = json_object(text)
    x, y = whole_number(v, "$.score_x", low, high), whole_number(v, "$.score_y", low, high)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def contract_errors(text: Column, fields: dict[str, tuple[str, bool]]) -> Column:
    """What a JSON message breaks, in settled order: malformed; unknown:<key>; missing:<field>; type:<field>.

    fields: name to (type as in JSON: BIGINT, STRING, BOOLEAN, ..., required).
    """
    v = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    unknown = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))), lambda k: F.concat(F.lit("unknown:"), k))
    kind = {f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in fields}
    there = {f: F.array_contains(keys, f) for f in fields}
    missing = [F.when(~there[f], F.lit(f"missing:{f}")) for f, (_, needed) in fields.items() if needed]
    wrong = [F.when(there[f] & ~kind[f].eqNullSafe(F.lit(t)), F.lit(f"type:{f}")) for f, (t, _) in fields.items()]
    found = F.concat(unknown, F.array_compact(F.array(*missing)), F.array_compact(F.array(*wrong)))
    return F.when(v.isNull() | keys.isNull(), F.array(F.lit("malformed"))).otherwise(found)


def captures(text: Column, pattern: str, names: list[str]) -> Column:
    """struct of a pattern's groups, NULL where the text has no match."""
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i).alias(n) for i, n in enumerate(names, 1)]))


def labels_of(metadata: Column) -> Column:
    """The distinct labels of map<key, array<struct<label>>>, in order."""
    every = F.flatten(F.map_values(F.coalesce(metadata, F.create_map().cast("map<string,array<struct<label:string>>>"))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda e: e["label"]), lambda x: x.isNotNull())))


def report_period(name: Column) -> Column:
    """struct(year, code, corrected) of a report's name with its period as (YYYY.MM); NULL without one."""
    year, month = F.regexp_extract(name, r"\((\d{4})\.(03|06|09|12)\)", 1), F.regexp_extract(name, r"\((\d{4})\.(03|06|09|12)\)", 2)
    code = F.element_at(F.create_map(*[F.lit(x) for kv in REPORT_CODES.items() for x in kv]), month)
    return F.when(year != "", F.struct(year.cast("int").alias("year"), code.alias("code"), name.rlike("|".join(CORRECTIONS)).alias("corrected")))


def digest(*parts: Column, length: int = 24) -> Column:
    """The first characters of the SHA-256 sum of the named parts as JSON without blanks."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, length)


def sha_fraction(text: Column) -> Column:
    """A fraction in [0, 1) from the first eight bytes of the SHA-256 sum."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def term_score(text: Column, terms: list[str], base: int, each: int, most: int) -> Column:
    """base and `each` for every term that stands as a word, at most `most`."""
    hits = [F.when(text.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){t}($|[^\p{{L}}\p{{N}}_])"), 1).otherwise(0) for t in terms]
    return F.least(F.lit(most), F.lit(base) + each * sum(hits[1:], hits[0]))


def with_roles(parts: dict[str, Column]) -> Column:
    """Texts one after another, each behind its role."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{role} "), F.coalesce(c, F.lit(""))) for role, c in parts.items()])


# The three rules by which texts are cut into tokens.
TOKEN_RULES = {"mixed": "[A-Za-z0-9]+", "lower": "[a-z0-9]+", "decimal": r"[a-z0-9]+(?:\.[0-9]+)?"}


def tokens_by(text: Column, rule: str) -> Column:
    return F.regexp_extract_all(text if rule == "mixed" else F.lower(text), F.lit(f"({TOKEN_RULES[rule]})"), 1)
