"""Column functions that parse and score text answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole answers that abstain, as patterns on text with single spaces; letter case makes no difference.
_LACKS = "specify state say mention provide contain include identify give indicate name tell explain describe confirm cover address reveal"
ABSTENTIONS = (
    r"(no[_ ]answer|unanswerable|unknown|n/?a) *[.!]*",
    r"(i )?(do not|don't) know(\b.*)?",
    r"(i )?(cannot|can't|am unable to) answer(\b.*)?",
    r"(there is )?not enough (information|context)(\b.*)?",
    r"(the )?answer (is )?(not (in|given by|provided by|stated in|mentioned in) (the )?(passage|context|text)|cannot be determined)(\b.*)?",
    r"(the )?(passage|context|text)\b.*\b(does not|doesn't|doesnt|cannot|can't) (" + _LACKS.replace(" ", "|") + r")\b.*",
)
# Words that tell a negation, and words that tell a comparison.
NEGATION = r"\b(no|not|never|without|cannot|doesn't|don't|isn't|aren't|lack|lacks|negative|unrelated)\b"
COMPARISON = r"\b[0-9]+(\.[0-9]+)?\b|\b(percent|percentage|fold|rate|high|higher|low|lower|more|less|fewer|increase|decrease)\b"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_question(c: Column) -> Column:
    return collapse(F.lower(c))


def canonical_question(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; in this order."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return collapse(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def is_abstention(c: Column) -> Column:
    """Whether a whole answer declines; an empty one, or NULL, does."""
    t = F.lower(collapse(F.coalesce(c, F.lit(""))))
    return (t == "") | t.rlike("^(" + "|".join(ABSTENTIONS) + r")\z")


def words(normalized: Column) -> Column:
    """The words of a normalised answer; none for an empty one."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    per = F.transform(F.array_distinct(a), lambda w: F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return F.aggregate(per, F.lit(0), lambda s, v: s + v)


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of words; two empty answers agree wholly."""
    a, b = words(prediction), words(reference)
    same = shared_count(a, b).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2 * same / (F.size(a) + F.size(b)))


def score_answer(prediction: Column, references: Column, impossible: Column) -> Column:
    """struct(em, f1, abstained): exact match and the best F1 over the references.

    For an impossible question both tell whether the answer abstains. Elsewhere an abstention scores nothing, unless
    it shares a word with a reference: then it holds an answer and is scored as one, and has not abstained.
    """
    p = normalize_answer(F.coalesce(prediction, F.lit("")))
    abstains = is_abstention(prediction)
    f1 = F.coalesce(F.array_max(F.transform(references, lambda r: token_f1(p, normalize_answer(r)))), F.lit(0.0))
    em = F.coalesce(F.exists(references, lambda r: normalize_answer(r) == p), F.lit(False))
    alone = abstains & (impossible | (f1 == 0.0))
    return F.struct(
        F.when(impossible, abstains).otherwise(em & ~alone).cast("int").alias("em"),
        F.when(impossible, abstains.cast("double")).otherwise(F.when(alone, 0.0).otherwise(f1)).alias("f1"),
        alone.alias("abstained"),
    )


def last_number(c: Column) -> Column:
    """The number after the last #### mark, else the last number that touches no letter, without thousands separators."""
    number = r"\$?(-?\d[\d,]*(?:\.\d+)?)"
    marked = F.try_element_at(F.regexp_extract_all(c, F.lit(r"####\s*" + number), 1), F.lit(-1))
    every = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z])" + number + r"(?![A-Za-z])"), 1), F.lit(-1))
    return F.replace(F.coalesce(marked, every), F.lit(","), F.lit(""))


def canonical_number(text: Column) -> Column:
    """A decimal text without trailing zeros; NULL for no number."""
    d = text.try_cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")


# A line that is an option letter, and a line that begins with one.
LETTER_LINE = r"(?im)^\s*(?:answer\s*:\s*)?\(?([A-D])\)?[.)]?\s*$"
LETTER_START = r"(?im)^\s*(?:answer\s*(?:is|:)\s*|option\s+)?\(?([A-D])\)?(?:[.)\s]|$)"


def option_letter(c: Column) -> Column:
    """A..D: the last line that is a letter alone, else the last line that begins with one."""
    last = lambda pattern: F.upper(F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), 1), F.lit(-1)))
    return F.coalesce(last(LETTER_LINE), last(LETTER_START))


def sentences(c: Column, least: int = 30, most: int = 8) -> Column:
    """The first sentences of at least `least` characters; the whole text if there is none."""
    long = F.slice(F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(s) >= least), 1, most)
    return F.when(F.size(long) == 0, F.array(c)).otherwise(long)


def query_category(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.rlike(NEGATION), "negation").when(t.rlike(COMPARISON), "numeric_or_comparative").otherwise("other")


# Units of amounts.
UNITS = {"원": 1, "백만원": 1_000_000, "억원": 100_000_000}


def amount(raw: Column, unit: Column) -> Column:
    """A whole amount with strict thousands groups, at most 18 digits in all, times its unit; NULL for empty text and for what is no amount."""
    t = F.trim(raw)
    digits = F.replace(F.replace(t, F.lit(","), F.lit("")), F.lit("-"), F.lit(""))
    sound = t.rlike(r"^-?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)\z") & (F.length(digits) <= 18)
    return F.when(sound, F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(38,0)") * unit.cast("decimal(18,0)"))


def unit_scale(unit: Column) -> Column:
    """What one of a unit is worth; NULL for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)


def extract_sql(output: Column) -> Column:
    """The statement within a model's output, without code fences and a closing semicolon."""
    plain = F.regexp_replace(output, r"(?i)```(?:sql)?", "")
    return F.nullif(F.regexp_replace(F.trim(F.regexp_extract(plain, r"(?is)\b(SELECT|WITH)\b.*", 0)), r";\s*\z", ""), F.lit(""))
