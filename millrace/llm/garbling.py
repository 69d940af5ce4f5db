"""Text decoded with a wrong character encoding: round-trip repair of its garbled runs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

# Encodings that UTF-8 bytes are taken for by mistake, the usual ones first.
TAKEN_FOR_UTF8 = ("cp1252", "latin_1", "cp949", "cp1251", "cp850", "mac_roman", "cp437", "cp1250", "cp1253", "cp1254", "iso8859_2", "iso8859_15", "cp852", "cp866", "koi8_r", "gbk", "big5", "cp932")
# Encodings that the bytes of Western European text are taken for.
TAKEN_FOR_LATIN = ("cp1251", "mac_roman", "cp437", "cp850", "cp1253", "koi8_r", "cp866", "iso8859_5", "cp852", "cp1250", "iso8859_2", "iso8859_7")
# Encodings that the bytes of Korean text are taken for.
TAKEN_FOR_KOREAN = ("cp1252", "latin_1", "mac_roman", "cp850", "cp437", "iso8859_15")

# What is left of the replacement character, or of quotes and dashes, when their bytes are read as cp1252.
LEFTOVERS = ("ï¿½", "â€")

LAYERS = 5
LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\s\d!-&(-/:-@\[-`{-~]+")
#: Joints that sound text puts between letters; also invisible characters.
_JOINTS = set(" ­·  ​‌‍⁠﻿‐‑‒–—‘’“”…×ºª°•→®™©   ′−　・")
#: What may close a quoted word in capitals, and is also the second byte of a garbled letter.
_AFTER_CAPITAL = set("‘’“”–—…»°ºª®©™ ")


@lru_cache(maxsize=1 << 16)
def cost(ch: str) -> float:
    """How far a character speaks for garbling; ASCII 0, whole Hangul of everyday use and Latin letters little."""
    o = ord(ch)
    if o < 0x80:
        return 0.0
    if ch == LOST or 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900:
        return 3.0
    if 0xAC00 <= o < 0xD7A4:
        try:
            ch.encode("euc_kr")
            return 0.4
        except UnicodeEncodeError:
            return 1.5
    if not unicodedata.category(ch).startswith("L"):
        return 1.0
    if 0xC0 <= o < 0x100 or 0x391 <= o < 0x3CA or 0x410 <= o < 0x450:
        return 0.5
    return 0.7 if o < 0x180 else 1.5 if o < 0x370 else 1.0


def total(text: str) -> float:
    return sum(map(cost, text))


def to_bytes(text: str, encoding: str) -> bytes | None:
    """text in a legacy encoding; undefined bytes were passed on as control characters, so they go back as bytes."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding in ("gbk", "big5", "cp932", "cp949"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


@lru_cache(maxsize=1 << 17)
def undo_utf8(run: str, layers: int = LAYERS) -> tuple[str, tuple[str, ...]] | None:
    """The cheapest text that a run of non-ASCII characters comes from, by one or more wrong readings of UTF-8."""
    best, best_cost = None, total(run)
    for e in TAKEN_FOR_UTF8:
        raw = to_bytes(run, e)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text == run or len(text) == 1 and ord(text) < 0x800 and not 0xA0 <= ord(text) < 0x180:
            continue  # a dash before a capital may happen to read as one letter of another alphabet
        found = (text, (e,))
        if layers > 1 and not text.isascii() and (deeper := undo_utf8(text, layers - 1)):
            found = (deeper[0], (*deeper[1], e))
        c = total(found[0])
        if c < best_cost - 1e-9:
            best, best_cost = found, c
    return best


_PIECES = re.compile(rb"[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}")


@lru_cache(maxsize=1 << 16)
def undo_inner(run: str) -> tuple[str, str] | None:
    """As undo_utf8 for pieces inside a run that touches sound characters: only those of three or four bytes."""
    for e in ("cp1252", "latin_1", "cp1251", "cp850", "mac_roman", "cp437", "cp1250"):
        chars = [to_bytes(ch, e) for ch in run]
        flat = b"".join(c if c and len(c) == 1 else b"\x00" for c in chars)
        out, at = [], 0
        for m in _PIECES.finditer(flat):
            try:
                text = m.group().decode("utf-8")
            except UnicodeDecodeError:
                continue
            if cost(text) <= 1.0 and total(run[m.start() : m.end()]) > cost(text) + 1:
                out += [run[at : m.start()], text]
                at = m.end()
        if out:
            return "".join([*out, run[at:]]), e
    return None


@lru_cache(maxsize=1 << 16)
def undo_korean(run: str) -> tuple[str, str] | None:
    """Korean text behind a run of Latin characters, two for a syllable."""
    if len(run) % 2:
        return None
    for e in TAKEN_FOR_KOREAN:
        raw = to_bytes(run, e)
        if raw is None or len(raw) % 2 or any(b < 0xA1 for b in raw):
            continue
        try:
            text = raw.decode("euc_kr")
        except UnicodeDecodeError:
            continue
        if all(0xAC00 <= ord(c) < 0xD7A4 for c in text):
            return text, e
    return None


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x80:
        return "ascii" if ch.isalpha() else "other"
    if not unicodedata.category(ch).startswith("L") or ch in "ªºµ":
        return "joint" if ch in _JOINTS or unicodedata.category(ch) in ("Mn", "Cf") else "symbol"
    if o < 0x100:
        return "latin1"
    if o < 0x250:
        return "latin2"
    return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "else"


@lru_cache(maxsize=1 << 16)
def word_cost(word: str) -> float:
    """How far the make-up of one word speaks for garbling: scripts mixed, symbols or capitals inside it."""
    kinds = [_script(c) for c in word]
    latin = sum(k in ("ascii", "latin1", "latin2") for k in kinds)
    if sum(k == "ascii" for k in kinds) < 2 or "else" in kinds:
        return 0.0
    c = 0.0
    for i, k in enumerate(kinds):
        if k in ("greek", "cyrillic"):
            c += 2.0 * (latin > 1 and (i == 0 or kinds[i - 1] != "joint"))
        elif k == "latin2":
            c += 0.7
        elif k == "latin1":
            up = word[i].isupper() and word[i] != "ß"
            after_small = i > 0 and word[i - 1].islower()
            before_small = 0 < i < len(word) - 1 and word[i + 1].islower() and word[i - 1].islower()
            c += 1.0 * (up and (after_small or before_small)) + 1.0 * (word[i] in "ßþÞðÐýÝ")
        elif k == "symbol":
            left = next((kinds[j] for j in range(i - 1, -1, -1) if kinds[j] != "symbol"), "other")
            right = next((kinds[j] for j in range(i + 1, len(kinds)) if kinds[j] != "symbol"), "other")
            c += 1.0 * (left in ("ascii", "latin1") and right in ("ascii", "latin1"))
    return c


def undo_latin(text: str) -> tuple[str, str] | None:
    """Western European text read in another one-byte encoding: all words with a cost are turned back at once.

    Accepted if one encoding takes the cost of each such word away, and at least 2 of it in all.
    """
    costly = {w for w in _WORD.findall(text) if not w.isascii() and word_cost(w) > 0}
    if sum(map(word_cost, costly)) < 2:
        return None
    best, gain = None, 0.0
    for e in TAKEN_FOR_LATIN:
        fixed, won = {}, 0.0
        for w in costly:
            raw = to_bytes(w, e)
            if raw is None:
                continue
            try:
                back = raw.decode("cp1252")
            except UnicodeDecodeError:
                continue
            drop = word_cost(w) - word_cost(back)
            if drop > 0 and word_cost(back) == 0:
                fixed[w], won = back, won + drop
        if won > gain:
            best, gain = (e, fixed), won
    if best is None or gain < 2 or gain < 0.8 * sum(map(word_cost, costly)):
        return None
    e, fixed = best

    def turn(m: re.Match) -> str:
        w = m.group()
        if w in fixed or w.isascii() or w.isalpha():
            return fixed.get(w, w)
        # a symbol at the end of a word that turns into a letter
        raw = to_bytes(w, e)
        back = raw.decode("cp1252", "replace") if raw else w
        return back if back.isalpha() else w

    return _WORD.sub(turn, text), e


@lru_cache(maxsize=1 << 14)
def _mangled(run: str) -> bool:
    """Hangul that everyday text hardly has, beside Han characters: UTF-8 read as Korean with bytes dropped."""
    han = {c for c in run if 0x4E00 <= ord(c) < 0xA000 or 0xF900 <= ord(c) < 0xFB00}
    odd = {c for c in run if cost(c) == 1.5}
    hangul = any(0xAC00 <= ord(c) < 0xD7A4 for c in run)
    return len(odd) >= 2 and bool(han) or len(han) >= 2 and len(odd) >= 1 and hangul


def _letter(ch: str) -> bool:
    return ch.isascii() and ch.isalpha()


def repair(text: str | None) -> tuple[str, list[str], bool] | None:
    """(restored text, wrong readings, whether nothing garbled is left), or None for text that is not garbled."""
    if not text or text.isascii():
        return None
    how: dict[str, None] = {}
    weak: list[tuple[int, int, str, str]] = []
    swaps: list[tuple[int, int, str]] = []
    runs = [(m.start(), m.end(), m.group()) for m in _RUN.finditer(text)]
    korean = {a: k for a, b, run in runs if b - a > 1 and (k := undo_korean(run))}
    # four or more Latin characters beyond ASCII in a row, all of them pairs of one Hangul, are no accident
    korean = {a: k for a, k in korean.items() if not (_letter(text[a - 1 : a]) and _letter(text[a + 2 * len(k[0]) : a + 2 * len(k[0]) + 1]))}
    strong = [k[1] for a, b, run in runs if (k := korean.get(a)) and len(run) >= 4 and len(set(run)) >= 3 and len(set(k[0])) >= 2]
    if not strong and korean and sum(0xAC00 <= ord(c) < 0xD7A4 for c in text) >= 10:
        # within Korean text a pair on its own is enough, unless it stands in a Latin word
        strong = [korean[a][1] for a, b, run in runs if a in korean and len(set(run)) > 1 and not _letter(text[a - 1 : a]) and not _letter(text[b : b + 1])]
    if strong and sum(b - a for a, b, run in runs if undo_utf8(run)) >= sum(b - a for a, b, _ in runs if a in korean):
        strong = []  # every character that speaks for Korean speaks for UTF-8 as well
    if strong:
        how.setdefault(f"euc_kr as {strong[0]}")
    for a, b, run in runs:
        if strong and a in korean:
            swaps.append((a, b, korean[a][0]))
        elif found := undo_utf8(run):
            names = ">".join(found[1])
            if a > 0 and text[a - 1].isupper() and len(run) == 2 and run[1] in _AFTER_CAPITAL:
                weak.append((a, b, found[0], names))
            elif not strong or len(run) > 2:
                swaps.append((a, b, found[0]))
                how.setdefault(f"utf_8 as {names}")
        elif not strong and (inner := undo_inner(run)):
            swaps.append((a, b, inner[0]))
            how.setdefault(f"utf_8 as {inner[1]}")
    if how:
        swaps += [w[:3] for w in weak]
    out, at = [], 0
    for a, b, new in sorted(swaps):
        out += [text[at:a], new]
        at = b
    restored = "".join([*out, text[at:]])
    if latin := undo_latin(restored):
        restored, e = latin
        how.setdefault(f"cp1252 as {e}")
    lost = LOST in restored or any(x in restored for x in LEFTOVERS)
    mangled = any(_mangled(run) for _, _, run in runs) if not how else False
    if lost:
        how.setdefault("bytes lost")
    elif mangled:
        how.setdefault("bytes dropped")
    return (restored, list(how), not (lost or mangled)) if how else None


def repair_texts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, restored, readings, whole): one row for each row whose text is garbled, wholly or in places.

    Each run of characters beyond ASCII is re-encoded under candidate legacy encodings and strictly decoded as what
    was meant, again and again for nested layers; a reading is accepted when the cost of garbling drops. `readings`
    names what was taken for what, `whole` is false where bytes were lost (the replacement character) so that the
    text could only be restored in part. NULL, empty and ASCII texts are never garbled. Texts are judged one by one
    and whole: no shuffle; ASCII texts don't leave the JVM. Repeated rows give repeated results.
    """
    rows = spread(df.select(F.col(row_id).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r) for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()) if (r := repair(t))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], b["id"].type), pa.array([r[0] for _, r in found], pa.string()), pa.array([r[1] for _, r in found], pa.list_(pa.string())), pa.array([r[2] for _, r in found], pa.bool_())],
                names=["id", "restored", "readings", "whole"],
            )

    out = rows.mapInArrow(judge, f"id {dict(df.dtypes)[row_id]}, restored string, readings array<string>, whole boolean")
    return out.withColumnRenamed("id", row_id)
