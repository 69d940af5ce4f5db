"""Evaluation texts that stand in training texts: wholly, in part, or with edits."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

#: Characters of evaluation items whose index is broadcast at once (about 30 bytes each); more are taken in blocks.
BLOCK_CHARS = 4_000_000
MIN_RUN = 5
#: An item stands edited in a document if at most this share of its words is altered, added or missing.
EDITED = 0.25
#: Widths of the windows that find edited items: each item has windows of the largest one that is at most 5/8 of its
#: words (else of all). Longer ones would hold more edits than CGK keeps close; a long item has many windows instead.
WIDTHS = (6, 10)
#: (repetitions, sampled steps) of the keys of windows of MIN_RUN words, and of item-sized windows.
SHORT, LONG = (2, 8), (8, 4)
DOCS_AT_ONCE = 500

_TAG = re.compile(r"</?[A-Za-z][^<>]*+>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=\w)[-‐]\r?\n[ \t]*(?=\w)")
_SIGNS = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Cf") + "]")
# Scripts written without spaces between words; each of their letters is a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, spacing, markup and invisible characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", unicodedata.normalize("NFKC", _SIGNS.sub("", text)))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


class WalkHash:
    """Bit-sampled keys of CGK embeddings of word windows.

    The embedding walks through a window in three times its length of steps; at each step it writes the word it
    stands on and moves on if a random bit of (step, word) says so. Words of equal windows give equal walks; an edit
    makes walks differ for a while and then meet again, so edit distance becomes Hamming distance. A key hashes the
    written words at `samples` random steps of the first half of the walk, which covers most of the window.
    """

    def __init__(self, width: int, repetitions: int, samples: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed + width)
        self.width, self.steps = width, 3 * width
        self.coins = rng.integers(1, 2**63, (repetitions, self.steps), dtype=np.uint64) | np.uint64(1)
        reach, early = min(self.steps, 3 * width // 2 + samples), min(samples // 2, 5)
        # half of the samples are early, so that most windows are told apart in a few steps
        self.samples = [np.sort(np.concatenate([rng.choice(5, early, replace=False), 5 + rng.choice(reach - 5, samples - early, replace=False)])) for _ in range(repetitions)]

    def walk(self, ids: np.ndarray, at: np.ndarray, r: int, stages: list[np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, keys) after each sampled step of repetition r; the last are the keys.

        windows are places in `at`: all, or with `stages`, the sorted keys that other windows had after each sampled
        step, only those that still share one.
        """
        padded = np.concatenate([ids, np.full(self.width, -1)]).astype(np.uint64)
        padded = (padded + np.uint64(2)) * np.uint64(0xBF58476D1CE4E5B9)  # spread, so that coins of unknown words fall too
        padded ^= padded >> np.uint64(31)
        which, place, key = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
        sampled = {int(s): i for i, s in enumerate(self.samples[r])}
        for step in range(max(sampled) + 1):
            word = np.where(place < self.width, padded[at[which] + np.minimum(place, self.width)], np.uint64(0xFFFF_FFFF))
            if step in sampled:
                key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                if stages is not None:
                    known = stages[sampled[step]]
                    keep = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key) if len(known) else np.zeros(0, np.int64)
                    which, place, key, word = which[keep], place[keep], key[keep], word[keep]
                yield which, key
            place += ((word * self.coins[r][step]) >> np.uint64(63)).astype(np.int64)

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(repetitions, len(at)) keys of the windows of `ids` that start at `at`."""
        return np.stack([list(self.walk(ids, at, r))[-1][1] for r in range(len(self.coins))])


def window_sums(ids: np.ndarray) -> np.ndarray:
    """A number for each window of MIN_RUN word numbers, the same for equal windows."""
    padded = np.concatenate([ids, np.full(MIN_RUN, -1)]).astype(np.uint64)
    out = np.zeros(len(ids), np.uint64)
    for k in range(MIN_RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(ids)]
    return out


def item_width(n_words: int) -> int:
    """The width of the windows that find an item of so many words edited."""
    return max((w for w in WIDTHS if 8 * w <= 5 * n_words), default=min(n_words, WIDTHS[0]))


class Windows:
    """Key tables of the windows of one width of some items: (repetition, sorted keys, item, place in the item)."""

    def __init__(self, width: int, kind: tuple[int, int], items: list[int], words_of: list[np.ndarray]) -> None:
        self.width, self.hash = width, WalkHash(width, *kind)
        parts = [(k, np.arange(len(words_of[k]) - width + 1)) for k in items if len(words_of[k]) >= width]
        flat, start, place = [], 0, []
        for k, own in parts:
            flat.append(words_of[k])
            place.append(start + own)
            start += len(words_of[k])
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        at = np.concatenate(place) if place else np.zeros(0, np.int64)
        item = np.concatenate([np.full(len(own), k) for k, own in parts]) if parts else at
        within = np.concatenate([own for _, own in parts]) if parts else at
        self.tables, self.stages = [], []
        sums = window_sums(ids)[at] if width == MIN_RUN and len(at) else np.zeros(len(at), np.uint64)
        for r, keys in enumerate(self.hash.keys(ids, at)):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], item[order], within[order], sums[order]))
            self.stages.append([np.unique(k) for _, k in self.hash.walk(ids, at, r)])

    def hits(self, ids: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows, keys) of the windows of `ids` at `at` whose key of repetition r is in the table."""
        for which, key in self.hash.walk(ids, at, r, self.stages[r]):
            pass
        return which, key


class ItemIndex:
    """Vocabulary, word numbers and window keys of a bounded block of evaluation items; built once, then broadcast."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        for i, text in items:
            w = words(text)
            if len(w) >= MIN_RUN:
                self.ids.append(i)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int64))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.sets = [set(w.tolist()) for w in self.words]
        self.short = Windows(MIN_RUN, SHORT, list(range(len(self.words))), self.words)
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by_width.setdefault(item_width(len(w)), []).append(k)
        self.long = [Windows(width, LONG, own, self.words) for width, own in sorted(by_width.items())]

    def parts(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(document, item) where windows of MIN_RUN words that share keys and words could cover half of the item.

        The documents are word numbers, -1 for a word of no item. They are hashed together. A key counts once per
        document, however often a common phrase is repeated in it.
        """
        flat, starts = _joined(docs, MIN_RUN)
        if len(flat) < MIN_RUN or not self.words:
            return
        at = np.flatnonzero(np.convolve(flat >= 0, np.ones(MIN_RUN, np.int64), "valid") >= MIN_RUN)
        doc = np.searchsorted(starts, at, "right") - 1
        span = int(self.lengths.max()) + 1
        found = []
        sums = window_sums(flat)[at]
        for r, (table, item, within, own) in enumerate(self.short.tables):
            hit, keys = self.short.hits(flat, at, r)
            low = np.searchsorted(table, keys, "left")
            order = np.lexsort((sums[hit], low, doc[hit]))
            d, low, code = doc[hit][order], low[order], sums[hit][order]
            once = np.ones(len(d), bool)
            once[1:] = (d[1:] != d[:-1]) | (low[1:] != low[:-1]) | (code[1:] != code[:-1])
            d, low, code = d[once], low[once], code[once]
            n = np.searchsorted(table, table[low], "right") - low
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            same = own[j] == np.repeat(code, n)  # verified with no edit: a run of this length is unbroken
            d, j = np.repeat(d, n)[same], j[same]
            found.append((d * len(self.words) + item[j]) * span + within[j])
        windows = np.unique(np.concatenate(found))
        if not len(windows):
            return
        pair, within = windows // span, windows % span
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        step = np.full(len(pair), MIN_RUN)
        step[:-1] = np.where(pair[1:] == pair[:-1], np.minimum(within[1:] - within[:-1], MIN_RUN), MIN_RUN)
        covered = np.add.reduceat(step, first)
        for p in pair[first][2 * covered >= self.lengths[pair[first] % len(self.words)]].tolist():
            yield divmod(p, len(self.words))

    def near(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """{(document, item): starts}: where the item could stand with edits, as item-sized windows share a key."""
        out: dict[tuple[int, int], list[int]] = {}
        for windows in self.long:
            width = windows.width
            flat, starts = _joined(docs, width)
            if len(flat) < width:
                continue
            at = np.flatnonzero(np.convolve(flat >= 0, np.ones(width, np.int64), "valid") >= width - max(1, int(EDITED * width)))
            doc = np.searchsorted(starts, at, "right") - 1
            found = []
            for r, (table, item, within, _) in enumerate(windows.tables):
                hit, keys = windows.hits(flat, at, r)
                low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
                n = high - low
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                h = np.repeat(hit, n)
                begin = np.maximum(at[h] - starts[doc[h]] - within[j], 0) // MIN_RUN  # nearby starts are one
                found.append(np.stack([doc[h], item[j], begin], axis=1))
            for d, k, begin in np.unique(np.concatenate(found), axis=0).tolist():
                out.setdefault((d, k), []).append(begin * MIN_RUN)
        return out


def _joined(docs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words one after another with a gap of `width` unknown words behind each; their starts."""
    gap = np.full(width, -1, np.int64)
    starts = np.cumsum([0, *(len(d) + width for d in docs)])
    return (np.concatenate([x for d in docs for x in (d, gap)]) if docs else np.zeros(0, np.int64)), starts


def least_edits(item: list[int], text: list[int]) -> int:
    """The least edit distance, in words, of the item and any piece of the text: Myers' bit vectors, one step a word."""
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score = full, 0, len(item)
    best = score
    for w in text:
        same = at.get(w, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        more, less, either = (more << 1) & full, (less << 1) & full, same | down
        up, down = less | (full & ~(either | more)), more & either
    return best


def exact_runs(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in document, place in item, length) of the unbroken runs of at least MIN_RUN words that both share."""
    windows: dict[tuple, list[int]] = {}
    own = item.tolist()
    for i in range(len(own) - MIN_RUN + 1):
        windows.setdefault(tuple(own[i : i + MIN_RUN]), []).append(i)
    text = doc.tolist()
    diagonals: dict[int, list[int]] = {}
    for j in np.flatnonzero(np.isin(doc, item)).tolist():
        for i in windows.get(tuple(text[j : j + MIN_RUN]), ()):
            diagonals.setdefault(j - i, []).append(i)
    runs = []
    for d, starts in diagonals.items():
        starts.sort()
        first = last = starts[0]
        for i in [*starts[1:], 1 << 60]:
            if i > last + 1:
                runs.append((first + d, first, last - first + MIN_RUN))
                first = i
            last = i
    return sorted(runs)


def best_chain(runs: list[tuple[int, int, int]], near: int, enough: int) -> int:
    """The most words that runs in item order, each at most `near` words behind the last one, cover together.

    Overlaps count once. Looks no further back than `near` allows, and stops at `enough`.
    """
    best = 0
    ends: list[tuple[int, int, int, int]] = []  # document start, item start, length, words covered up to here
    back = 0
    longest = max((n for _, _, n in runs), default=0)
    for j, i, n in runs:
        while back < len(ends) and ends[back][0] + longest + near < j:
            back += 1
        covered = n
        for pj, pi, pn, pc in ends[back:]:
            overlap = max(0, pi + pn - i, pj + pn - j)
            if pi < i and pj < j and overlap < n and j - (pj + pn) <= near:
                covered = max(covered, pc + n - overlap)
        ends.append((j, i, n, covered))
        best = max(best, covered)
        if best >= enough:
            break
    return best


def edited_there(distinct: set[int], item: np.ndarray, region: list[int], most: int) -> bool:
    """Whether the item stands in the region with at most `most` edits; each edit loses at most one of its distinct words."""
    return len(distinct.difference(region)) <= most and least_edits(item.tolist(), region) <= most


def leaks(index: ItemIndex, texts: list[str | None], near: int) -> list[tuple[int, int, int, int, int]]:
    """(place of the text, number of the item, words covered, words of the item, edits) for each item that stands in a text."""
    get = index.vocab.get
    docs = [np.array([get(x, -1) for x in words(t)], np.int64) for t in texts]
    out = []
    possible: dict[tuple[int, int], list[int] | None] = dict.fromkeys(index.parts(docs))
    for pair, starts in index.near(docs).items():
        possible.setdefault(pair, starts)
    for (d, k), starts in possible.items():
        item, size = index.words[k], len(index.words[k])
        most = int(EDITED * size)
        if starts is not None:  # by item-sized windows only: looked at where they lie, before the whole text is
            if not any(edited_there(index.sets[k], item, docs[d][max(0, x - most) : x + MIN_RUN + size + most].tolist(), most) for x in starts):
                continue
        covered = best_chain(exact_runs(item, docs[d]), near, size)
        edits = least_edits(item.tolist(), docs[d].tolist())
        if 2 * covered >= size or edits <= most:
            out.append((d, k, covered, size, edits))
    return out


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, near: int = 20) -> DataFrame:
    """(doc_id, item_id, covered, item_words, edits): the items that stand in a document, in part or edited.

    covered: the item's words in unbroken runs of MIN_RUN or more words, in the item's order, with at most `near`
    other words between two runs. edits: the least edit distance, in words, of the whole item and a piece of the
    document. A row has 2 * covered >= item_words, or edits <= EDITED * item_words, or both.

    Windows of items and documents are embedded by the CGK random walk and bit-sampled into keys, some repetitions of
    it; windows that share a key are candidates, which are then verified. Windows sized by the item find it edited: CGK
    keeps windows with few edits close, and the verification is the exact edit distance. Windows of MIN_RUN words find
    items of which only parts stand there (half of a larger window may then differ, far beyond what CGK keeps close); an unbroken run has none but equal windows, which always share their keys, so no such case is lost.
    Letters of scripts without spaces count as words.

    The items are a query set against all documents: their index is built once for a block of at most BLOCK_CHARS
    characters and broadcast, a bound that does not grow with the documents; documents are read whole, once a block,
    and never shuffled. NULL and empty texts, and items with fewer than MIN_RUN words, have no case. Repeated rows
    come out once per document and item.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    number = pa.string() if kinds[1] == "string" else pa.int64()
    rows = spread(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text")
        shared = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in block.collect()]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
                found = [(ids[a + x[0]], index.ids[x[1]], *x[2:]) for a in range(0, len(ids), DOCS_AT_ONCE) for x in leaks(index, texts[a : a + DOCS_AT_ONCE], near)]
                cols = list(zip(*found)) if found else [[]] * 5
                types = [batch["id"].type, number, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "item", "covered", "item_words", "edits"])

        parts.append(rows.mapInArrow(search, f"id {kinds[0]}, item {'string' if kinds[1] == 'string' else 'bigint'}, covered int, item_words int, edits int"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # of repeated rows, and of items with one id, the row with most words covered, then fewest edits
    best = every.groupBy("id", "item").agg(F.max(F.struct("covered", (-F.col("edits")).alias("e"), "item_words")).alias("b"))
    return best.select(F.col("id").alias(doc_id), F.col("item").cast(kinds[1]).alias(item_id), "b.covered", "b.item_words", (-F.col("b.e")).alias("edits"))
