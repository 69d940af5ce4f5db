"""Operators on text and model training data against hand-made cases, brute force and round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import garbling, leakage
from millrace.llm.defects import answer_defects, language, shortened_forms
from millrace.llm.packing import first_fit_decreasing, pack
from millrace.llm.tokens import count_tokens
from millrace.llm.top_n import _first_rows, merge_first, top_n_per_group


# Problem 1


def test_merge_skips_repeats_and_stops():
    runs = [[(-3.0, "a"), (-1.0, "b")], [(-3.0, "b"), (-2.0, "c")], []]
    assert merge_first(runs, 3) == [(-3.0, "a"), (-3.0, "b"), (-2.0, "c")]
    assert merge_first([], 3) == []


def test_merge_of_many_runs(monkeypatch):
    monkeypatch.setattr("millrace.llm.top_n.FAN_IN", 3)
    rng = random.Random(11)
    parts = [sorted({(-rng.randrange(9), f"i{rng.randrange(40)}") for _ in range(5)}) for _ in range(23)]
    t = pa.table({"g0": [1] * sum(map(len, parts)) + [2], "run": [r for r, p in enumerate(parts) for _ in p] + [0], "item": [i for p in parts for _, i in p] + ["z"], "score": [-float(s) for p in parts for s, _ in p] + [1.0]})
    rows, places = _first_rows(t, ["g0"], 7)
    want, seen = [], set()
    for s, i in sorted(x for p in parts for x in p):
        if i not in seen:
            seen.add(i)
            want.append((-float(s), i))
    got = {(g, p): (s, i) for g, p, s, i in zip(t["g0"].take(rows).to_pylist(), places.tolist(), t["score"].take(rows).to_pylist(), t["item"].take(rows).to_pylist())}
    assert got == {(1, p + 1): x for p, x in enumerate(want[:7])} | {(2, 1): (1.0, "z")}


def test_merge_looks_at_no_more_than_it_gives():
    class Watched(list):
        seen = 0

        def __getitem__(self, i):
            Watched.seen = max(Watched.seen, i)
            return super().__getitem__(i)

    runs = [Watched((-float(1000 - 3 * k - r), f"i{3 * k + r}") for k in range(300)) for r in range(3)]
    assert [x[1] for x in merge_first(runs, 6)] == [f"i{k}" for k in range(6)] and Watched.seen <= 2


@pytest.mark.parametrize(("run_rows", "held", "fan_in"), [(7, 1 << 16, 64), (3, 5, 2), (1 << 19, 1 << 16, 64)])
def test_top_n_brute(spark, monkeypatch, run_rows, held, fan_in):
    monkeypatch.setattr("millrace.llm.top_n.RUN_ROWS", run_rows)
    monkeypatch.setattr("millrace.llm.top_n.HELD_ROWS", held)
    monkeypatch.setattr("millrace.llm.top_n.FAN_IN", fan_in)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*"abcdefghijklmnop", "é", "z" * 5000, "", None]), rng.choice([0.0, -0.0, 1.5, 2.0, -3.0, float("inf"), float("nan"), None]), i, 7) for i in range(900)]
    df = spark.createDataFrame(rows, "q bigint, p string, s double, run int, g0 int").repartition(6)
    got = {}
    for r in top_n_per_group(df, ["q"], "p", "s", 4).collect():
        got.setdefault(r.q, {})[r.place] = (r.p, r.s)
    best = {}
    for q, p, s, *_ in rows:
        if q is not None and p is not None and s is not None and s == s:
            best[q, p] = max(best.get((q, p), s), s)
    for q in {k for k, _ in best}:
        want = sorted(((p, s) for (k, p), s in best.items() if k == q), key=lambda x: (-x[1], x[0].encode()))[:4]
        assert [got[q][i + 1] for i in range(len(got[q]))] == want
    assert set(got) == {k for k, _ in best}
    assert top_n_per_group(df.limit(0), ["q"], "p", "s", 4).count() == 0


# Problem 4

QA = "id string, q string, t string, im boolean, acc array<string>, a string, n int, b string, m int, form string"


def defects(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], QA)
    return {(r.id, r.field): r.defect for r in answer_defects(df, "id", "q", "t", [("a", "n"), ("b", "m")], "acc", "im").collect()}


Q = "What is the delivery fee of Orbo Mills?"
FULL = "The delivery fee of Orbo Mills is 12 euros, because the contract was renewed in 1999."
KO = "Orbo Mills의 배송비는 얼마입니까?"


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        (Q, None, "empty"),
        (Q, " ​", "empty"),
        (Q, "...", "empty"),
        (Q, "I cannot answer this question.", "refusal"),
        (Q, "It cannot be less than 12 euros, which is the fee stated.", None),
        (Q, "I am not sure, but the text says 12 euros.", None),
        (Q, "12 euros", None),
        (Q, FULL, None),
        (Q, FULL.rstrip("."), None),
        (Q, "The delivery fee of Orbo Mills is 12 euros, because the", "truncated"),
        (Q, "The delivery fee of Orbo Mills is 12 euros, because the contract was ren", "truncated"),
        (Q, "The delivery fee of Orbo Mills is 12 euros…", "truncated"),
        (Q, 'The delivery fee ("', "truncated"),
        (Q, Q, "copy"),
        (Q, f"**{Q.upper()}** {Q}", "copy"),
        (Q, f"Q: {Q}", "copy"),
        (Q, f"So {Q[0].lower()}{Q[1:]}", "copy"),
        (Q, f"{Q} Well, ok.", "copy"),
        (Q, f"{Q} 12 euros.", None),
        (Q, "Orbo Mills的运费是12欧元，因为合同在1999年续签。", "other_language"),
        (Q, "Orbo Millsの配送料は12ユーロです。契約が更新されたためです。", "other_language"),
        (Q, "Стоимость доставки Orbo Mills составляет 12 евро.", "other_language"),
        (Q, "Die Liefergebühr von Orbo Mills beträgt 12 Euro, weil der Vertrag nicht verlängert wurde.", "other_language"),
        (Q, "Les frais de livraison sont de 12 euros, parce que le contrat a été renouvelé avec eux.", "other_language"),
        (Q, "Il costo della consegna di Orbo Mills è di 12 euro, perché il contratto è stato rinnovato.", "other_language"),
        ("¿Cuál es la tarifa de Orbo Mills?", "Les frais de livraison sont de 12 euros, parce que le contrat a été renouvelé avec eux.", "other_language"),
        ("Qual é a taxa da Orbo Mills?", "Il costo della consegna di Orbo Mills è di 12 euro, perché il contratto è stato rinnovato.", "other_language"),
        (Q, "A taxa de entrega da Orbo Mills é de 12 euros, porque o contrato foi renovado.", "other_language"),
        (Q, "Orbo Mills의 배송비는 12유로이며, 이는 계약이 갱신되었기 때문이다.", "other_language"),
        (KO, "12유로", None),
        (KO, "본문에는 해당 내용이 없습니다.", "refusal"),
        (KO, "Orbo Mills의 배송비는 12유로이며, 이는", "truncated"),
        ("¿Cuál es la tarifa de Orbo Mills?", "No lo sé.", "refusal"),
        ("Qual é a taxa da Orbo Mills?", "O texto não menciona essa informação.", "refusal"),
        (None, "12 euros", None),
    ],
)
def test_defects(spark, question, answer, defect):
    rows = [("full", Q, "Orbo Mills", False, ["12 euros"], FULL, 20, FULL, 20), ("x", question, "Orbo Mills", False, ["12 euros"], answer, 9, "12 euros", 2)]
    assert defects(spark, rows).get(("x", "a")) == defect


def test_impossible_answers_lists_and_nulls(spark):
    rows = [
        ("i", Q, None, True, [], "", None, "I do not know.", None),
        ("j", Q, None, True, ["12", None], "n/a", 1, Q, 1),
        ("k", Q, None, False, [" ", None], "12", 1, "12", 1),
        ("k", Q, None, False, [" ", None], "12", 1, "12", 1),
        ("l", Q, None, None, None, "I do not know.", 1, "12", 1),
        (None, None, None, None, None, None, None, "x" * 200_000, None),
    ]
    assert defects(spark, rows) == {("j", "acc"): "contradiction", ("j", "b"): "copy", ("k", "acc"): "empty", ("l", "a"): "refusal", (None, "a"): "empty"}
    assert defects(spark, []) == {}


def test_shortened_forms_over_ranges(spark):
    forms = [("a", 0), ("a b", 0), ("a b c", 3), ("b", 0), ("ba", 1), ("c", 0), ("d", 2)] + [(f"e {i:04d} tail", 1) for i in range(300)] + [("e 0", 0)]
    df = spark.createDataFrame(forms, "form string, n_closed bigint")
    assert {r.form for r in shortened_forms(df).collect()} == {"a", "a b", "b", "e 0"}


def test_shortened_forms_where_ranges_cut(spark):
    """Ranges of one form each and of several: the stack of open forms goes on over any number of them."""
    forms = [("the x", 0), ("the x is", 0), ("the x is red", 1), ("the x or", 0), ("the y", 0), ("the y 1", 0), ("the y 12", 0), ("the y 123", 0), ("the y 123 é", 2), ("the z", 0), ("the zz", 0)]
    want = {"the x", "the x is", "the y", "the y 1", "the y 12", "the y 123"}
    df = spark.createDataFrame(forms, "form string, n_closed bigint")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in (1, 2, 3, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.form for r in shortened_forms(df).collect()} == want, n
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_length_limit(spark):
    """Unfinished answers, none a beginning of another, that pile up at one token count."""
    rows = [(f"u{i}", Q, None, False, ["1"], f"zz{i} yy{i} xx{i} ww{i} vv{i}", 24, "1", 1) for i in range(30)] + [("other", Q, None, False, ["1"], "some odd words stand here alone", 9, "1", 1)]
    got = defects(spark, rows)
    assert {k[0] for k in got} == {f"u{i}" for i in range(30)} and set(got.values()) == {"truncated"}
    assert {k[0] for k in defects(spark, rows[22:])} == {f"u{i}" for i in range(22, 30)}  # a tenth of the table, or so
    assert not defects(spark, rows[26:])


def test_language():
    assert language("The fee is what the passage says") == "en" and language("12 euros") is None
    assert language("El precio de la casa, según el texto, es de 12 euros por mes") == "es"
    assert language("Самый короткий ответ") == "cyrillic" and language("答えは十二です") == "ja" and language("答案是十二") == "zh"


# Problem 8


def test_first_fit_decreasing_brute():
    rng = random.Random(2)
    for _ in range(100):
        sizes = np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 50))])
        free, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            j = next((j for j, f in enumerate(free) if f >= sizes[i]), None)
            if j is None:
                j = len(free)
                free.append(30)
            free[j] -= sizes[i]
            want[i] = j
        assert [want[i] for i in range(len(sizes))] == first_fit_decreasing(sizes, 30).tolist()


def test_pack(spark):
    rng = random.Random(3)
    rows = [(rng.choice([i, i, 5, None]), rng.choice([0, 1, 7, 30, 99, 100, 101, 250, 1000, None]), "clash") for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, size bigint, container string")
    got = pack(df, "id", "size", 100, group_items=60).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.size
    assert max(used.values()) <= 100
    assert sum(r.size for r in got) == sum(s or 0 for _, s, _ in rows)
    assert sum(r.piece == 0 for r in got) == len(rows)
    assert all(r.size == 100 for r in got if r.start + r.size < max(x.start + x.size for x in got if x.id == r.id) and r.id not in (5, None))
    # no more than a container a group above what first-fit decreasing guarantees
    assert len(used) <= 11 / 9 * sum(used.values()) / 100 + 10
    assert pack(df.limit(0), "id", "size", 100).count() == 0


def test_pack_deals_out_equal_rows(spark):
    df = spark.range(20_000).select(F.lit(None).cast("bigint").alias("id"), F.lit(3).alias("size"))
    per = pack(df, "id", "size", 100, group_items=1000).groupBy((F.col("container") / 2**32).cast("int").alias("g")).count().collect()
    assert len(per) == 20 and max(r["count"] for r in per) < 1300


def test_pack_fill(spark):
    """Within 2 % of the least number of containers that any packing needs."""
    df = spark.range(30_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("size"))
    n, used = pack(df, "id", "size", 2048).agg(F.count_distinct("container"), F.sum("size")).first()
    assert n <= 1.02 * -(-used // 2048)


def test_tokens_round_trip(spark):
    df = spark.createDataFrame([(1, "plain words"), (2, ""), (3, None), (4, "a<|endoftext|>b"), (5, "한국어 é " * 5000)], "i int, x string")
    n = {r.i: r.n_tokens for r in count_tokens(df, "i", "x").collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 3 and n[5] > 15_000


# Problem 9

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"before {ITEM} after", True),
        (f"<p>{ITEM.upper().replace(' ', '<br/>,  ')}</p>", True),
        (ITEM.replace("three", "th­r​ee").replace("six", "s-\nix"), True),
        ("one two three four five x six seven y nine ten eleven twelve thirteen", True),
        ("one two three four five six seven eight", True),
        ("one two three four five six seven", False),
        ("one two three four x six seven eight nine y eleven twelve thirteen fourteen", False),
        ("nine ten eleven twelve thirteen " + "far " * 60 + "one two three four five", False),
        ("one two three four five " + "far " * 60 + "nine ten eleven twelve thirteen", False),
        ("nine ten eleven twelve thirteen one two three four five", False),
        ("", False),
        (None, False),
        ("filler " * 50_000 + ITEM, True),
    ],
)
def test_leakage(spark, text, found):
    docs = spark.createDataFrame([(7, text, "x"), (7, text, "y")], "id bigint, text string, covered string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "")], "item bigint, body string")
    got = leakage.leaked_items(docs, "id", "text", items, "item", "body").where("2 * covered >= item_words").collect()
    assert [(r.id, r.item) for r in got] == ([(7, 1)] if found else [])


def brute_leak(item, doc, near):
    """The longest chain over all maximal equal runs, without any index."""
    runs = []
    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] == doc[j] and not (i and j and item[i - 1] == doc[j - 1]):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                    n += 1
                if n >= 5:
                    runs.append((j, i, n))
    return leakage.best_chain(sorted(runs), near, 10**9)


def test_leakage_against_brute_force():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 30)))) for k in range(25)]
    index = leakage.ItemIndex(items)
    texts = []
    for _ in range(120):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join([rng.choice(vocab) for _ in range(rng.randint(0, 20))] + w + [rng.choice(vocab) for _ in range(5)]))
    got = {(d, index.ids[k]) for d, k, covered, size, _ in leakage.leaks(index, texts, 20) if 2 * covered >= size}
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if 2 * brute_leak(x.split(), t.split(), 20) >= len(x.split())}
    assert got == want and len(want) > 50


VOCAB = [f"w{i}" for i in range(2000)]


def edited(rng, every, n):
    """(items, texts): texts hold one item each with every so manieth word altered, added or missing."""
    items = [(k, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(8, 60)))) for k in range(n)]
    texts = []
    for _, t in items:
        w = t.split()
        for i in range(every - 1, len(w), every):
            w[i] = rng.choice(["changed", "new " + w[i], ""]) if every > 5 else "changed"
        texts.append("before " * 30 + " ".join(w) + " after" * 30)
    return items, texts


@pytest.mark.parametrize("every", [5, 7])
def test_edited_items(every):
    items, texts = edited(random.Random(every), every, 200)
    got = {(d, k) for d, k, _, size, edits in leakage.leaks(leakage.ItemIndex(items), texts, 20) if edits <= leakage.EDITED * size}
    assert sum((i, i) in got for i in range(200)) >= 190 and all(a == b for a, b in got)


def test_edited_items_need_the_walk(monkeypatch):
    """Keys of whole windows in place of sampled walks find none of the items with every fifth word altered."""

    def plain(self, ids, at):
        padded = np.concatenate([ids, np.full(self.width, -1)]).astype(np.uint64)
        out = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
        return np.stack([out] * len(self.coins))

    items, texts = edited(random.Random(5), 5, 100)
    monkeypatch.setattr(leakage.WalkHash, "keys", plain)
    assert len(leakage.leaks(leakage.ItemIndex(items), texts, 20)) < 10


def test_least_edits_brute():
    rng = random.Random(6)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if i == 0 else row
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert leakage.least_edits(a, b) == min(row)


def test_scripts_without_spaces(spark):
    item = "昨天下午三点左右一位顾客退回了两件有瑕疵的蓝色外套并要求全额退款"
    docs = spark.createDataFrame([(1, "说明：" + item + "。"), (2, "前文" + item[:20] + "后文"), (3, item.replace("顾客", "买家").replace("蓝色", "红色")), (4, "今天没有任何退货")], "id bigint, text string")
    items = spark.createDataFrame([(9, item)], "item bigint, body string")
    got = {r.id: (r.covered, r.edits) for r in leakage.leaked_items(docs, "id", "text", items, "item", "body").collect()}
    assert set(got) == {1, 2, 3} and got[1] == (len(item), 0) and got[3][1] == 3


def test_long_tags():
    assert leakage.words(f"a <b title='{'x' * 5000}'>b</b> c") == ["a", "b", "c"]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    docs = spark.createDataFrame([("a", ITEM)], "id string, text string")
    items = spark.createDataFrame([("i", ITEM), ("j", ITEM + " more"), ("k", "other words " * 9)], "item string, body string")
    assert {r.item for r in leakage.leaked_items(docs, "id", "text", items, "item", "body").collect()} == {"i", "j"}
    assert leakage.leaked_items(docs, "id", "text", items.limit(0), "item", "body").count() == 0
    assert leakage.leaked_items(docs.limit(0), "id", "text", items, "item", "body").count() == 0


# Problem 10

SOUND = [
    "A avaliação não é “ótima” – já enviei três mensagens por €50.",
    "¡Muy buena compra! Todavía no se ha dañado; la señal llegó.",
    "옆집도 같은 이불을 샀는데 아주 좋습니다. 가격이 27천 원인 것을 생각하면 만족합니다.",
    "The café’s décor vase – 40 × 20 cm – cost €15.",
]


@pytest.mark.parametrize("text", SOUND)
@pytest.mark.parametrize("encoding", ["cp1252", "latin_1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"])
@pytest.mark.parametrize("layers", [1, 2])
def test_utf8_read_wrongly_comes_back(text, encoding, layers):
    bad = text
    for _ in range(layers):
        out = ""
        for b in bad.encode("utf-8"):
            try:
                out += bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                out += chr(b)
        bad = out
    restored, how, whole = garbling.repair(bad)
    assert restored == text and whole


@pytest.mark.parametrize("text", SOUND + ["ATENÇÃO: NÃO PASSE; “IRMÔ VÃO PASILLO «Ñ»", "√57 is ±83 µm, π │ total │ 70 │ ──", "The label reads “модель Ветер” § 70", "¿¿¿Y el número de guía???", "처음 책 참 천천히 체크 二 ㎏ ㈜", "São–Paulo cas​telo jar\xaddin 5\xa0kg", "plain", "", None, "kΩ and Dvořák at 25 °C", "ß" * 100_000])
def test_sound_text_stays(text):
    assert garbling.repair(text) is None


def test_korean_read_as_latin():
    bad = SOUND[2].encode("euc_kr").decode("latin_1")
    assert garbling.repair(bad)[0] == SOUND[2]


@pytest.mark.parametrize("encoding", ["cp1251", "mac_roman", "cp437"])
def test_latin_read_as_other_one_byte(encoding):
    text = "La compañía rectificó la nota, según la última página del año."
    assert garbling.repair(text.encode("cp1252").decode(encoding))[0] == text


def test_lost_bytes_are_told():
    restored, how, whole = garbling.repair(SOUND[1].encode("latin_1").decode("utf-8", "replace"))
    assert not whole and "bytes lost" in how


def test_repair_table(spark):
    df = spark.createDataFrame([(1, "Ã©tÃ©", "a"), (1, "Ã©tÃ©", "a"), (2, None, "b"), (3, "", "c"), (None, "Ol�", "d")], "id bigint, text string, restored string")
    got = sorted((r.id or 0, r.restored, r.whole) for r in garbling.repair_texts(df, "id", "text").collect())
    assert got == [(0, "Ol�", False), (1, "été", True), (1, "été", True)]
    assert garbling.repair_texts(df.limit(0), "id", "text").count() == 0
