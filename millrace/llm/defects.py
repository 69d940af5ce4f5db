"""Defective answers in prompt and response pairs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise, spread

#: Shortened forms up to this number are broadcast; more are joined by a shuffle.
BROADCAST_FORMS = 200_000
#: A token count is a length limit if its unfinished answers exceed those of the counts around it by so many standard
#: deviations of a Poisson count (and are five times as many).
SPIKE = 6

# Ways to decline or to say that the answer is not given, by language.
REFUSALS = {
    "en": (
        r"\bno answer\b", r"^n ?/? ?a$", r"\bunanswerable\b", r"\bnot answerable\b", r"\bnot enough (information|context|detail|data)", r"\binsufficient (information|context|detail|data)",
        r"\b(cannot|can ?not|can ?t|could ?not|couldn ?t|unable to|not able to|won ?t|will not) (\w+ ){0,3}?(answer|help|assist|say|tell|determin\w*|provide|respond|comply|give|infer\w*|find|be determined|be answered|be inferred)",
        r"\bdo(es)?(n ?t| not) (\w+ )?(mention|state|say|specify|give|provide|contain|include|know|tell|indicate|have enough)", r"\bnot (mentioned|stated|specified|given|provided|available|found|known)\b",
        r"\b(rather|prefer) not\b", r"\bdecline\b", r"\bno (such )?(information|details?|data) (is|are|was|about|on|in|available|given|provided)", r"\bi (do not|don ?t) know\b", r"^unknown$", r"\bi ?m sorry\b", r"^sorry\b", r"\bas an (ai|assistant)\b",
    ),
    "pt": (
        r"\bnão (posso|consigo|sei|podemos|é possível|há|menciona|informa|consta|diz|traz|especifica|responderei)\b", r"\b(prefiro|melhor) não\b", r"\bsem (resposta|informaç)", r"\bdesculpe\b", r"\binformaç(ão|ões) insuficientes?\b", r"\bnão (foi|está) (informad|mencionad|especificad)", r"\brecuso\b", r"\bsinto muito\b", r"\bimpossível (responder|determinar|saber)",
    ),
    "es": (
        r"\bno (puedo|podemos|lo sé|sé|es posible|hay|menciona|indica|dice|consta|especifica|aclara|se menciona|se indica|se especifica|responderé)\b", r"\b(prefiero|mejor) no\b", r"\bsin (respuesta|información)\b", r"\blo siento\b", r"\binformación insuficiente\b", r"\bdesconozco\b", r"\bme niego\b", r"\bimposible (responder|determinar|saber)",
    ),
    "ko": (r"수 없(습니다|어|으|다|음)", r"모르(겠|ㅂ니다|는|다)", r"모릅니다", r"(내용|정보|답|언급|근거|설명)[은는이가]?\s*(본문에\s*)?(없|부족|나와 있지 않)", r"부족합니다", r"보류", r"죄송", r"거절", r"언급(되지|하지) 않", r"알 수 없", r"어렵습니다"),
}

# Frequent small words, by language.
SMALL_WORDS = {
    "en": "the of is are was were what which how does do did has have had it its that this these and or to in on for with by from as at be been because according passage after before not which who whose all an",
    "pt": "o os as um uma do da dos das no na nos nas é são foi foram que qual quais quanto não pelo pela ao à em com por para porque segundo texto depois hoje mais seu sua se uma pratica vale e",
    "es": "el los las un una del al lo y es son fue fueron qué cuál cuáles cuánto no por para porque según texto tras hoy más su sus se con en tiene que la le como sobre pasaje e",
}
# Frequent small words of further languages; only those that no language above has count there.
MORE_WORDS = {
    "fr": "le les des du et est une un dans pour que qui pas sur avec par au aux ce cette sont été mais ou où il elle ils nous vous leur ses son sa plus même être avait ont à selon après parce",
    "de": "der die das und ist nicht ein eine einer eines einem einen zu den dem mit von auf für im sich des auch nach wie wird wurde aus bei oder war sind hat haben nur noch über weil durch als",
    "it": "il lo gli di che non è una per del della dei delle nel nella con sono più ha hanno questo questa anche come si alla dal perché stato stata dopo secondo loro",
    "nl": "de het een van en is niet dat met voor op te zijn aan er ook bij naar wordt door werd maar uit over omdat heeft hebben was volgens deze dit",
}
# Letters by script, each script standing for its languages.
SCRIPTS = {"zh": "一-鿿㐀-䶿", "ja": "ぁ-ヿ", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "arabic": "\u0600-ۿ", "hebrew": "\u0590-\u05ff", "devanagari": "\u0900-ॿ", "thai": "\u0e00-\u0e7f"}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_UNSPACED = re.compile("[" + "".join(SCRIPTS[k] for k in ("zh", "ja", "thai")) + "]")  # each letter counts as a word
# Words that add nothing before or after a repeated question.
FILLERS = frozenset("so well ok okay hmm um yes please thanks então bem pois ora sim certo obrigado pues bueno entonces vale sí claro gracias 그럼 그러면 음 네 그래서".split())
_SMALL = {lang: frozenset(w.split()) for lang, w in SMALL_WORDS.items()}
_ONLY = {lang: w - frozenset().union(*(o for k, o in _SMALL.items() if k != lang)) for lang, w in _SMALL.items()}
_MORE = {lang: frozenset(w.split()) - frozenset().union(*_SMALL.values()) for lang, w in MORE_WORDS.items()}
# Words that cannot end a sentence.
DANGLING = frozenset("the a an of in on at by for with from to and or that which who because as is are was were its their than into o os um uma do da dos das no na em com por para e que é porque pelo pela de el los las un una del al y es por según la le su sin ou or nor if when while".split())
# Syllables that a Korean sentence can end with.
KOREAN_ENDS = frozenset("다요까죠임음함됨오라네지군나")
# Labels before a repeated question.
_LABEL = re.compile(r"^(q|question|pergunta|pregunta|질문|문)(?=.)")

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?。！？]+[\"'”’»)\]*]*\s*$")
_CUT = re.compile(r"(…|\.\.\.+|[,;:([{\"“«'‘\-–—/&])\s*$|[([{]\s*[\"“'‘«]+\s*$")
_HANGUL = re.compile("[가-힣]")


def norm(text: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip().casefold() if text else ""


def bare(text: str) -> str:
    """Letters and digits only."""
    return "".join(_WORD.findall(text.casefold()))


def language(text: str, title: str = "") -> str | None:
    """The language, or the script of a third of the letters; None where the words don't tell.

    Scripts first, then small words of English, Portuguese and Spanish, unless those of a further language are far
    more. The title, a name, says nothing about the language.
    """
    t = norm(text)
    if title:
        t = t.replace(norm(title), " ")
    letters = [c for c in t if c.isalpha()]
    hangul = len(_HANGUL.findall(t))
    if hangul and hangul * 3 >= len(letters):
        return "ko"
    own = {k: len(r.findall(t)) for k, r in _SCRIPTS.items()} if not t.isascii() else {}
    if own and 3 * sum(own.values()) >= len(letters) > 0:
        top = max(own, key=lambda k: own[k])
        if top in ("zh", "ja"):  # Japanese has Chinese characters too
            top = "ja" if 10 * own["ja"] >= own["zh"] + own["ja"] else "zh"
        if 3 * (own["zh"] + own["ja"] if top in ("zh", "ja") else own[top]) >= len(letters):
            return top
    w = _WORD.findall(t)
    score = {k: sum(x in _SMALL[k] for x in w) + 2 * sum(x in _ONLY[k] for x in w) for k in _SMALL}
    score["pt"] += 3 * len(re.findall("[ãõ]|ç[aoãõ]|ê|ô", t))
    score["es"] += 3 * len(re.findall("[ñ¿¡]|ción|ó\\b", t))
    more = {k: 3 * sum(x in own_words for x in w) for k, own_words in _MORE.items()}
    foreign = max(more, key=lambda k: more[k])
    if more[foreign] >= 6 and more[foreign] >= 1.5 * max(score.values()) + 2 and 3 * sum(more[k] == more[foreign] for k in more) <= 3:
        return foreign
    first, second, *_ = sorted(score, key=lambda k: -score[k])
    return first if score[first] >= 3 and score[first] >= 1.3 * score[second] + 1 else None


_REFUSAL = {k: re.compile("|".join(v)) for k, v in REFUSALS.items()}


def declines(answer: str, question: str, accepted: list[str]) -> bool:
    """Whether the answer declines or says that nothing is given, and gives nothing: no number beyond the question's, no accepted answer."""
    plain = re.sub(r"\s+", " ", re.sub(r"[’'`´]", " ", norm(answer)))
    plain = re.sub(r"[^\w\s/가-힣]", " ", plain)
    plain = re.sub(r"\s+", " ", plain).strip()
    if not any(r.search(plain) for r in _REFUSAL.values()):
        return False
    if set(re.findall(r"\d+", plain)) - set(re.findall(r"\d+", norm(question))):
        return False
    mine = bare(answer)
    return not any(b and b in mine for b in map(bare, accepted))


def _core(text: str) -> str:
    """Letters and digits, without fillers at the ends."""
    w = _WORD.findall(text.casefold())
    while w and w[0] in FILLERS:
        w.pop(0)
    while w and w[-1] in FILLERS:
        w.pop()
    return "".join(w)


def copies(answer: str, question: str) -> bool:
    """Whether the answer says nothing but the question, once or more, with or without a label or fillers around it."""
    a, q = bare(answer), bare(question)
    if not a or not q:
        return False
    for x in (a, _LABEL.sub("", a)):
        if len(x) % len(q) == 0 and x == q * (len(x) // len(q)):
            return True
    core = _core(question)
    return bool(core) and core in (_core(answer), _core(_LABEL.sub("", answer.casefold().strip())))


def form(answer: str, question: str, title: str | None, whole_words: bool = False) -> tuple[str, bool]:
    """(the wording without what is particular to the question, whether it ends as a sentence does).

    The title, words of the question and numbers give way to marks, so that answers to different questions that are
    worded alike become neighbours when sorted. Unless `whole_words`, a last word cut short counts as the word of the
    question that it begins.
    """
    a, q = norm(answer), norm(question)
    closed = bool(_END.search(a)) and not _CUT.search(a)
    a = re.sub(r"[.!?。！？…\"'”’»)\]*\s]+$", "", a)
    if title:
        a = a.replace(norm(title), " ◦ ")
    asked = set(_WORD.findall(q)) | set(_WORD.findall(norm(title or "")))
    out: list[str] = []
    tokens = re.findall(r"[^\W_]+|[^\w\s]", a)
    for i, w in enumerate(tokens):
        partial = not whole_words and i == len(tokens) - 1 and not closed and any(x.startswith(w) and x != w for x in asked)
        mark = "#" if w[0].isdigit() else "◦" if w == "◦" or w in asked or partial else w
        if mark in "#◦" and out and out[-1] == mark:
            continue
        if mark == "#":
            w = re.sub(r"^[\d.,]+", "", w)
            out += [mark, w] if w else [mark]
        else:
            out.append(mark)
    return re.sub(r"# (?:[.,] # ?)+", "# ", " ".join(out)), closed


def judge(answer: str | None, question: str | None, title: str | None, accepted: list[str], impossible: bool | None) -> tuple[str | None, str, bool, bool]:
    """(defect that the answer itself shows, its form, whether it ends as a sentence, whether it is a bare value)."""
    text, question = answer or "", question or ""
    if not bare(text):
        return (None if impossible else "empty"), "", True, False
    if copies(text, question):
        return "copy", "", True, False
    n_words = len(_WORD.findall(text)) + (0 if text.isascii() else len(_UNSPACED.findall(text)))
    mine, theirs = language(text, title or ""), language(question, title or "")
    foreign = mine is not None and theirs is not None and mine != theirs and n_words >= 4
    if declines(text, question, accepted):
        return ("other_language" if foreign else None) if impossible else "refusal", "", True, False
    if foreign:
        return "other_language", "", True, False
    f, closed = form(text, question, title)
    value = n_words <= 4 and any(c.isdigit() for c in text) or n_words <= 2 or bare(text) in map(bare, accepted)
    if _CUT.search(norm(text)):
        return "truncated", f, False, value
    if not closed and not value and _WORD.findall(norm(text))[-1] in DANGLING and not _HANGUL.search(text[-3:]):
        return "truncated", f, False, value
    if not closed and not value and n_words >= 4 and mine == "ko" and norm(text)[-1] not in KOREAN_ENDS:
        return "truncated", f, False, value
    return None, f, closed, value


def shortened_forms(forms: DataFrame) -> DataFrame:
    """(form): forms never seen closed of which a longer form, seen closed, is a continuation.

    `forms` has one row per form, with n_closed. They are sorted in ranges and compared with their neighbours: what
    begins with a form follows it at once. A range takes over from those before it the open forms that its own first
    form continues, so no task sees more than its range and the result does not depend on where ranges are cut.
    """
    spark = forms.sparkSession
    placed = forms.repartitionByRange("form").sortWithinPartitions("form").withColumn("part", F.spark_partition_id())
    kept = materialise(placed, "forms")
    heads = kept.groupBy("part").agg(F.min("form").alias("form")).orderBy("part").collect()
    carried: dict[int, tuple[str, list[int]]] = {}  # by range: its first form, lengths of the open forms before it that this continues
    if len(heads) > 1:
        ends = spark.createDataFrame([(a["part"], b["form"]) for a, b in zip(heads, heads[1:])], "part int, next string")
        still = kept.where("n_closed = 0").join(F.broadcast(ends), "part").where(F.col("next").startswith(F.col("form")))
        opened = {r["part"]: r["lengths"] for r in still.groupBy("part").agg(F.sort_array(F.collect_list(F.length("form"))).alias("lengths")).collect()}
        first, lengths = "", []
        for a, b in zip(heads, heads[1:]):
            lengths = [n for n in lengths if b["form"].startswith(first[:n])] + opened.get(a["part"], [])
            first = b["form"]
            carried[b["part"]] = (first, lengths)
    shared = spark.sparkContext.broadcast(carried)  # one row per range

    def neighbours(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("form")
        out: set[str] = set()
        first, lengths = shared.value.get(key[0].as_py(), ("", []))
        open_ = [first[:n] for n in lengths]
        for f, n in zip(table["form"].to_pylist(), table["n_closed"].to_pylist()):
            while open_ and not f.startswith(open_[-1]):
                open_.pop()
            if n:
                out.update(x for x in open_ if len(f) > len(x))
            else:
                open_.append(f)
        return pa.table({"form": pa.array(sorted(out), pa.string())})

    return kept.groupBy("part").applyInArrow(neighbours, "form string").distinct()


def answer_defects(df: DataFrame, row_id: str, question: str, title: str, answers: list[tuple[str, str]], accepted: str, impossible: str) -> DataFrame:
    """(row_id, field, defect) for each defective response field; `answers` pairs text columns with token counts.

    empty: NULL, or no letter and no digit. copy: nothing but the question, perhaps repeated or labelled. refusal:
    declines or says that nothing is given, and gives nothing. other_language: a sentence in another language than
    the question. truncated: breaks off before its sentence is finished, which shows in the text (an ellipsis, an
    open bracket or quote, a word that cannot end a sentence), by comparison with sorted neighbours (a form of which
    a longer one is the continuation, while nobody ends a sentence there), or by a length limit (token counts at
    which unfinished forms pile up). The first that applies counts. Where `impossible` is true an empty answer or
    refusal is right; NULL is taken for false. The accepted list is judged as `answers`: empty, or contradiction.
    Repeated rows come out once; NULL in any column is no error; a NULL id is an id like any other.
    """
    cols = [F.col(row_id).alias("id"), F.col(question).alias("q"), F.col(title).alias("t"), F.col(impossible).alias("im"), F.col(accepted).alias("acc")]
    for i, (text, tokens) in enumerate(answers):
        cols += [F.col(text).alias(f"a{i}"), F.col(tokens).cast("bigint").alias(f"n{i}")]
    names = [t for t, _ in answers]

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "field", "defect", "form", "plain", "closed", "value", "tokens")}
            data = b.to_pydict()
            for r in range(b.num_rows):
                good = [x for x in (data["acc"][r] or []) if x]
                for i, name in enumerate(names):
                    defect, f, closed, value = judge(data[f"a{i}"][r], data["q"][r], data["t"][r], good, data["im"][r])
                    plain = f if closed or not f else form(data[f"a{i}"][r], data["q"][r] or "", data["t"][r], True)[0]
                    for k, v in zip(out, (data["id"][r], name, defect, f, plain, closed, value, data[f"n{i}"][r])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], b["id"].type), pa.array(out["field"], pa.string()), pa.array(out["defect"], pa.string()), pa.array(out["form"], pa.string()), pa.array(out["plain"], pa.string()), pa.array(out["closed"], pa.bool_()), pa.array(out["value"], pa.bool_()), pa.array(out["tokens"], pa.int64())],
                names=list(out),
            )

    kind = dict(df.dtypes)[row_id]
    judged = materialise(spread(df.select(*cols)).mapInArrow(classify, f"id {kind}, field string, defect string, form string, plain string, closed boolean, value boolean, tokens bigint"), "answers")
    both = judged.where(F.col("form") != "").select(F.explode(F.array_distinct(F.array("form", "plain"))).alias("form"), "closed")
    forms = both.groupBy("form").agg(F.count_if("closed").alias("n_closed"), F.count(F.lit(1)).alias("n"))
    short = materialise(shortened_forms(forms), "short-forms")
    if short.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS:
        short = F.broadcast(short)
    pending = judged.where(F.col("defect").isNull() & ~F.col("closed") & ~F.col("value") & (F.col("form") != ""))
    cut = pending.select("id", "field", F.explode(F.array_distinct(F.array("form", "plain"))).alias("form")).join(short, "form", "left_semi")
    # a length limit: far more unfinished answers at a token count than at the counts around it
    finished = forms.where("n_closed > 0").select("form")
    unfinished = judged.where(~F.col("closed") & ~F.col("value") & (F.col("form") != "")).join(finished, "form", "left_anti")
    hist = unfinished.where(F.col("tokens").isNotNull()).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    around = Window.orderBy("tokens").rangeBetween(-8, 8)  # one row per token count
    spikes = hist.withColumn("others", (F.sum("n").over(around) - F.col("n")) / 16).where((F.col("n") > 5 * F.col("others")) & (F.col("n") >= F.col("others") + SPIKE * F.sqrt(F.col("others") + 1))).select("tokens")
    limited = pending.join(finished, "form", "left_anti").join(F.broadcast(spikes), "tokens", "left_semi")
    own = judged.where(F.col("defect").isNotNull()).select("id", "field", "defect")
    texts = F.filter(F.coalesce("acc", F.array().cast("array<string>")), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    empty, wrong = (F.size(texts) == 0) & ~F.coalesce("im", F.lit(False)) & F.col("im").isNotNull(), (F.size(texts) > 0) & F.coalesce("im", F.lit(False))
    listed = df.select(*cols).select("id", F.lit(accepted).alias("field"), F.when(empty, "empty").when(wrong, "contradiction").alias("defect")).where(F.col("defect").isNotNull())
    every = own.unionByName(listed)
    for extra in (cut, limited):
        every = every.unionByName(extra.select("id", "field", F.lit("truncated").alias("defect")))
    return every.distinct().withColumnRenamed("id", row_id)
