"""Packing, mixing, sentences."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfold.llm import mixing, packing, sentences, tokens


def sizes(spark, rows):
    return spark.createDataFrame(rows, "key long, n_tokens long")


def limits(spark, *caps):
    return spark.createDataFrame([(i, c) for i, c in enumerate(caps)], "limit_id long, capacity_tokens long")


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_every_token_lies_in_one_container(spark, capacity):
    rng = np.random.default_rng(capacity)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 150, 200))] + [(500, None), (None, 3), (501, 5000)]
    got = packing.packed(sizes(spark, rows), limits(spark, capacity, None)).collect()
    load, parts = Counter(), defaultdict(list)
    for r in got:
        load[r["limit_id"], r["shard"], r["container"]] += r["n_tokens"]
        parts[r["key"]].append((r["start_token"], r["n_tokens"]))
    assert max(load.values()) <= capacity
    for key, n in rows:
        if key is None or not n:
            continue
        at = 0
        for start, size in sorted(parts.pop(key)):
            assert start == at and size > 0
            at += size
        assert at == n
    assert not parts
    assert all(len([r for r in got if r["key"] == k]) == 1 for k, n in rows if k is not None and n and n <= capacity)


def test_containers_are_nearly_full(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.lognormal(4, 1, 4000))]
    found = packing.fill(packing.packed(sizes(spark, rows), limits(spark, 512, 2048)), limits(spark, 512, 2048)).collect()
    assert all(r["fill"] > 0.98 for r in found)


def test_packing_nothing(spark):
    assert packing.packed(sizes(spark, []), limits(spark, 10)).count() == 0
    assert packing.packed(sizes(spark, [(1, 5)]), limits(spark)).count() == 0


def test_costs_are_even():
    length = np.sort(np.random.default_rng(2).integers(20, 60, 300))[::-1]
    at = packing.pack(length, 500)
    cost = np.sort(np.bincount(at, weights=length + packing.QUADRATIC * length**2))[1:]  # the last one opened is not full
    assert cost.std() / cost.mean() < 0.01


SIZES = "key long, source string, n_tokens long, quality double"
TARGETS = "mix_id long, source string, target_share double, max_repeats long"


def test_shares_and_caps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["big", "Small ", None][min(2, i % 7 // 3)], int(n), float(q)) for i, (n, q) in enumerate(zip(rng.integers(1, 90, 3000), rng.uniform(0.1, 1, 3000)))]
    rows += [(9000 + i, "tiny", 10, 0.5) for i in range(20)] + [(9999, "big", 0, 0.5)]
    df, want = spark.createDataFrame(rows, SIZES), spark.createDataFrame([(1, "BIG", 0.6, 2), (1, "tiny", 0.3, 3), (1, "absent", 0.1, 9), (2, "small", 1.0, 1), (3, "big", None, 1), (4, "big", 1.0, 0)], TARGETS)
    drawn = mixing.draw(df, want).collect()
    caps = {(1, "big"): 2, (1, "tiny"): 3, (2, "small"): 1}
    assert {(r["mix_id"], r["source"]) for r in drawn} == set(caps)
    assert all(1 <= r["copies"] <= caps[r["mix_id"], r["source"]] for r in drawn)
    assert len({(r["mix_id"], r["key"]) for r in drawn}) == len(drawn)
    report = {(r["mix_id"], r["source"]): r for r in mixing.shares(mixing.draw(df, want), df, want).collect()}
    assert report[1, "tiny"]["tokens"] == 600  # three whole epochs
    assert report[1, "big"]["actual_share"] == pytest.approx(2 / 3, abs=0.01)
    assert report[1, "absent"]["actual_share"] == 0
    assert report[2, "small"]["tokens"] == sum(n for _, s, n, _ in rows if s == "Small ")
    assert sorted(map(tuple, mixing.draw(df, want).collect())) == sorted(map(tuple, drawn))


def test_quality_comes_first(spark):
    rows = [(i, "s", 10, 1.0 if i % 2 else 0.05) for i in range(2000)] + [(5000, "t", 2000, 1.0)]
    df, want = spark.createDataFrame(rows, SIZES), spark.createDataFrame([(1, "s", 0.5, 1), (1, "t", 0.5, 1)], TARGETS)
    took = [r["key"] for r in mixing.draw(df, want).collect() if r["source"] == "s"]
    assert sum(k % 2 for k in took) > 0.8 * len(took)


def test_mixing_nothing(spark):
    df, want = spark.createDataFrame([], SIZES), spark.createDataFrame([(1, "a", 1.0, 1)], TARGETS)
    assert mixing.draw(df, want).count() == 0
    assert [r["actual_share"] for r in mixing.shares(mixing.draw(df, want), df, want).collect()] == [0.0]


def test_sizes_are_those_of_the_tokenizer(spark):
    texts = ["Hello  world", "", None, "สวัสดี 你好 <|endoftext|>", "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "x")], "doc_id long, text string")
    got = {r["key"]: r["n_tokens"] for r in tokens.sized(df, "doc_id", "text").collect()}
    enc = tokens.encoding(tokens.TOKENIZER)
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


PIECES = [
    ["Dr. Kesmore met Mr. and Mrs. Corvane at 10 a.m. on Monday.", "They left at 6 p.m.", "Nobody stayed!"],
    ["Bring supplies, e.g. a hat, etc., to St. Mary Library.", "Our annex (approx. 31 sq. ft.) holds 1,855 coats."],
    ['"You changed my week!" wrote a parent.', "She said, \"Come early. Bring water.\"", "Helpers (most are new. Some are not.) share one van."],
    ["J. R. Aszody and the U.S. Field Kitchen Assn. will weigh backpacks.", "Write to crew@a-hands.example or visit www.b.example/join for details.", "i-Serve is the name of our app."],
    ["Am 14. Januar öffnen wir um 11 Uhr.", "Dr. Ellowen und Hr. Wexmoor leiten die Schicht Nr. 41.", "Eine Schicht dauert ca. 4 Stunden, d. h. rund 37,4 % weniger.", "„Ist das schwer?“, fragte ein Helfer."],
    ["« Venez tôt. Prenez de l'eau », a dit Ruvenko.", "Prévoyez chaussures, gourde, etc.", "Quelle joie de revoir les familles !", "M. Grisolm arrive dès 6 h 30."],
    ["—¿Quién quiere leer? —preguntó Quennor.", "¡Venga a conocer el museo!", "Nos vemos a las 6 a. m. en punto."],
    ["هل يمكنك تخصيص 4 ساعات؟", "أردنا عشرة صناديق... فوصل 75 صندوقا!", "قالت المنسقة: «تعالوا مبكرا. أحضروا الماء».", "نحتاج إلى 16 متطوعين."],
    ["डॉ. अरवेल विद्यालय में मिलेंगे।", 'उन्होंने कहा, "जल्दी आइए। पानी लाइए।"', "क्या आप 6 घंटे दे सकते हैं?"],
]
GLUED = [
    ["您能抽出5个小时来照顾流浪狗吗？", "她说：“请早点来。记得带水。”", "“太好了！”他笑着说，“下周四我还来。”", "2.6版报名表已更新；旧表（含附件。共9页）作废。", "我们想要十箱……结果收到了2,712箱。"],
    ["「早めに来てください。水も持ってきてください。」と担当者は話しました。", "来週も開催します!", "昨年は5,311世帯を支援しました。"],
]


def parts(text, model=None):
    return [text[a:b] for a, b in sentences.cut(text, model)]


@pytest.mark.parametrize("pieces", PIECES)
def test_sentences(pieces):
    assert parts(" ".join(pieces)) == pieces
    assert parts("  " + "  ".join(pieces) + " ") == pieces


@pytest.mark.parametrize("pieces", GLUED)
def test_scripts_without_spaces(pieces):
    assert parts("".join(pieces)) == pieces


def test_thai_ends_at_spaces_and_lines():
    a, b, c = "เราต้องการอาสาสมัคร 42 คนเพื่อช่วยดูแลสุนัขจรจัดทุกวันศุกร์", "เธอถามว่า “มาช่วยส่งอาหารได้ไหม” แล้วทุกคนก็ยกมือ", "เปิดเวลา 11.30 น. ที่โกดังทุกวันจันทร์"
    assert parts(f"{a} {b}\n{c}") == [a, b, c]


def test_lines():
    text = "About Us\n\nWe sort books. Wrapped lines\nend nothing at\nall.\n- Able to lift 20 lb. boxes\n2. Photo ID\nWhat to Bring\nCome early.See you there\n"
    assert parts(text) == ["About Us", "We sort books.", "Wrapped lines\nend nothing at\nall.", "- Able to lift 20 lb. boxes", "2. Photo ID", "What to Bring", "Come early.", "See you there"]


def test_odd_texts(spark):
    texts = [None, "", " \n \n", "...", "no end", "A. B. C.", "(" * 3000, "x. " * 20_000, "“open", "🎉! Great.", "a\r\nb"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "Yes. No."), (3, "...")], "doc_id long, text string")
    got = defaultdict(list)
    for r in sentences.sentences(df, "doc_id", "text").collect():
        got[r["key"]].append((r["start_at"], r["end_at"]))
    assert not {0, 1, 2, None} & set(got)
    assert got[4] == [(0, 6)] and len(got[3]) == 2
    for k, spans in got.items():
        if k == 3:
            continue
        ends = 0
        for a, b in sorted(spans):
            assert a >= ends and b > a and texts[k][a:b] == texts[k][a:b].strip()
            ends = b
        assert "".join(texts[k].split()) == "".join("".join(texts[k][a:b].split()) for a, b in sorted(spans))


def test_no_text_is_lost_with_a_model(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    spans = defaultdict(list)
    for r in sentences.sentences(df, "doc_id", "text").collect():
        spans[r["key"]].append((r["start_at"], r["end_at"]))
    for k, t in text.items():
        assert "".join((t or "").split()) == "".join("".join(t[a:b].split()) for a, b in sorted(spans.get(k, [])))


@pytest.mark.parametrize("opens, closes", ["“”", "()", '""', "„“", "«»"])
def test_long_speech_stays_whole(opens, closes):
    said = " ".join(f"Bring {i} coats to the annex today." for i in range(200))
    pieces = ["We met on Monday.", f"She wrote {opens}{said}{closes} to all of us.", "They left early."]
    assert len(said) > 5000 and parts(" ".join(pieces)) == pieces
    assert len(sentences.shielded("(" * 200_000 + "„ " * 100_000)) == 0


CLAUSES = {
    "en": ["please bring water and gloves", "the shelter opens at eight", "we need ten people for the garden", "our team meets on friday"],
    "es": ["traiga agua y guantes", "el refugio abre a las ocho", "buscamos diez personas para el jardín", "nuestro equipo se reúne el viernes"],
}
THAI_SAID = ["คุณสามารถมาช่วยดูแลสุนัขได้ไหม", "ทหารผ่านศึกรออยู่ที่โรงเรียนเสมอ", "ชวนเพื่อนมาที่ครัวชุมชนด้วยกันนะ", "เราต้องการอาสาสมัครทุกวันศุกร์"]


def test_events_between_unmarked_words(spark):
    """The model learns from marked texts where sentences begin and end, and finds them where no mark stands."""
    r, rows = random.Random(6), []
    for clauses in CLAUSES.values():
        for _ in range(150):
            rows.append(" ".join(r.choice(clauses).capitalize() + ". " for _ in range(6)).strip())
    for _ in range(150):
        rows.append(" ".join(r.sample(THAI_SAID, 4)))
    typed = [" ".join(c) for c in CLAUSES.values()] + ["".join(THAI_SAID)]
    df = spark.createDataFrame(list(enumerate([*rows, *typed])), "doc_id long, text string")
    got = defaultdict(list)
    for x in sentences.sentences(df, "doc_id", "text").where(f"key >= {len(rows)}").orderBy("start_at").collect():
        got[x["key"] - len(rows)].append(typed[x["key"] - len(rows)][x["start_at"] : x["end_at"]])
    assert got == {0: CLAUSES["en"], 1: CLAUSES["es"], 2: THAI_SAID}


def test_events_at_all_places_of_unmarked_paragraphs(spark):
    """Also in paragraphs with commas or colons, in short ones, and near the end of a run of Thai."""
    r, rows = random.Random(7), []
    clauses, thai = ["please bring water, gloves and a hat", "one rule: be on time", "doors open", "tools provided"], [*THAI_SAID[:2], "จบนะ"]
    for _ in range(300):
        rows.append(" ".join(x.capitalize() + "." for x in r.choices(clauses, k=6)))
        rows.append(" ".join(r.sample(thai, 3)))
    typed = [(" ", [clauses[1], clauses[0], clauses[3]]), ("\n", ["Doors open", "tools provided"]), ("", thai)]
    df = spark.createDataFrame(list(enumerate([*rows, *[by.join(x) for by, x in typed]])), "doc_id long, text string")
    got = defaultdict(list)
    for x in sentences.sentences(df, "doc_id", "text").where(f"key >= {len(rows)}").orderBy("start_at").collect():
        by, said = typed[x["key"] - len(rows)]
        got[x["key"] - len(rows)].append(by.join(said)[x["start_at"] : x["end_at"]])
    assert got == dict(enumerate(said for _, said in typed))
