"""Rules for untrusted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule names and their patterns.
RULES = {
    "ignore_instructions": r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instructions?|rules|above|previous)\b",
    "role_change": r"(?i)\b(you are now|act as|pretend to be)\b",
    "tool_call": r"(?i)\b(call|invoke|run|execute)\s+(the\s+)?(tool|function|command)\b",
    "exfiltration": r"(?i)\b(send|post|upload|forward)\b.{0,60}\b(password|secret|token|key|credentials?)\b",
    "system_prompt": r"(?i)\bsystem prompt\b",
}
def flags(text: Column) -> Column:
    """Names of the rules that a text breaks, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in RULES.items()]))


def unwrap_base64(text: Column) -> Column:
    """Each line that is Base64 of UTF-8 text decoded, other lines as they are."""
    def line(x: Column) -> Column:
        body = F.try_to_binary(x, F.lit("base64"))
        plain = F.try_validate_utf8(body.cast("string"))
        return F.when((F.length(x) >= 16) & x.rlike(r"^[A-Za-z0-9+/]+={0,2}\z") & (F.length(x) % 4 == 0), F.coalesce(plain, x)).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def guard_text(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, rules, blocked) after Base64 lines are opened."""
    t = F.coalesce(F.col(text), F.lit(""))
    opened = F.when(t.rlike(r"(?m)^[A-Za-z0-9+/]{16,}={0,2}$"), unwrap_base64(t)).otherwise(t)
    return df.select(row_id, flags(opened).alias("rules")).withColumn("blocked", F.size("rules") > 0)
