import random

import pytest

from weftline.llm import leakage, packing, sentences

UNITS = [
    ["Dr. Sobul reached Besk at 6:12 a.m. with 4 men.", "Prices rose 24.5 per cent."],
    ['"They came at night.', 'We had no guns," said Morin.', "Was the bridge mined?"],
    ['"Why did nobody warn us?" asked a teacher.', "Nobody knew."],
    ["J. K. Darrik left on 9 Sept. 2021...and nobody replaced the old man.", "Stop the shelling!"],
    ["Am 3. März erreichte Oberst a. D. Zenrik die Stadt.", "Der Bericht Nr. 49 nennt u. a. Morivo."],
    ["Ген. Вальдис прибыл в г. Вештар и привёл ок. 21 бойцов.", "«Они пришли ночью.", "Оружия не было», — сказал он."],
    ["El informe núm. 175 cita al Dr. Pelane.", "¡Basta!", "¿Por qué?"],
    ["“他们夜里来到。", "我们没有武器。”瓦尔迪说。", "停止炮击！"], ["「もう水がない。」と医師は語った。", "丘から撤退した。"],
    ["他们已经撤退了", "但是没有人回来"], ["兵士は撤退しました", "しかし市場は閉まったままです"], ["“我喜欢这本书。”", "小说的作者离开了。"], ["“我们没有武器。”他喊道。", "市场关闭。"],
    ["ទាហានបានដកថយ។", "ផ្សារបិទ។"], ["စစ်သားများ ဆုတ်ခွာသွားသည်။", "ဈေးပိတ်သည်။"], ["Զինվորները նահանջեցին։", "Շուկան փակ է։"],
    ["रिपोर्ट सं. 63 के अनुसार सीमा 30.3 कि.मी. लंबी है।", "डॉ. ओर्वेन ने कहा, \"पानी नहीं है।\"", "वे गए।"],
    ["يذكر التقرير أن طول الحدود 15.8 كم؛ ولم يذكر أوردوما.", "لماذا؟", "قال د. كرستو: «لم يعد لدينا ماء»."],
    ["ชาวบ้านเมืองเวชตาปล่อยตัวประกัน 33 คน", "นพ. เทชคูล กล่าวว่าไม่มีน้ำ", "รายงานเลขที่ 172 ระบุว่าชายแดนยาว 32.3 กม. ใกล้เมืองทัสมีรา"],
]


@pytest.mark.parametrize("units", UNITS)
def test_units(units):
    spaceless = "。" in "".join(units) or "！" in "".join(units)
    text = ("" if spaceless else " ").join(units)
    ends = sentences.Splitter().ends(text)
    at, got = 0, []
    for e in ends:
        got.append(text[at:e].strip())
        at = e
    assert got == units


def test_learned_words():
    rng = random.Random(2)
    words = ["政府军", "医生", "桥梁", "市场"]
    runs = ["".join(rng.choice([*words, *"甲乙丙丁戊己庚辛壬癸子丑寅卯"]) for _ in range(9)) for _ in range(400)]
    found = sentences.learned_words(runs, 4)
    assert set(words) <= found and not {"军医", "生桥", "场市"} & found
    assert sentences.WordLattice(found).path("医生政府军甲市场") == ["医生", "政府军", "甲", "市场"]
    splitter = sentences.learn(["ทหารปิดสะพาน 33 คน\n" * 6, "a " * 10])
    assert splitter.ends("ทหารปิดสะพาน 33 คน") == [18]


def test_words_are_learned_from_all_texts(spark):
    """Counts come from every document: a word of few of many documents counts as often as it stands, and parts add up to the whole."""
    rows = [(i, "plain words here, no more") for i in range(9_000)] + [(10_000 + i, f"He saw qzx. {i} men, then qzx. 5 more") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    counted = sentences.learn_all(df)
    assert "qzx" in counted.leading and "here" not in counted.leading
    assert counted.leading == sentences.learn([t for _, t in rows]).leading
    words = ["政府军", "医生", "桥梁", "市场"]
    rng = random.Random(4)
    texts = ["".join(rng.choice([*words, *"甲乙丙丁戊己庚辛壬癸子丑寅卯"]) for _ in range(9)) for _ in range(400)] + ["ทหารปิดสะพาน 33 คน\n" * 6]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    one, all_ = sentences.learn(texts), sentences.learn_all(many)
    assert all_.han.words == one.han.words >= set(words) and all_.lattice.words == one.lattice.words


def test_unit_positions(spark):
    text = "1. One thing\n\n  - Two. Three!  \n \nEnd of text.Next one"
    ends = sentences.Splitter().ends(text)
    assert [text[:e].split("\n")[-1].strip()[-6:] for e in ends] == ["thing", "- Two.", "Three!", " text.", "xt one"] or len(ends) == 5
    assert all(not text[e - 1].isspace() for e in ends)
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, " \n\t", "x"), (4, "a. B" * 20000, "x"), (None, "A.", "x")], "doc_id long, text string, end_pos string")
    got = sentences.unit_ends(df)
    assert sorted({r.doc_id for r in got.collect()}) == [1, 4] and got.where("doc_id = 1").count() == 5
    assert sentences.unit_ends(df.limit(0)).count() == 0


def item(rng, n=40):
    return " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n)).capitalize() + "."


def test_leaks(spark):
    rng = random.Random(8)
    items = {i: item(rng, 40 + i) for i in range(30)}
    noise = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))

    def worn(words):
        return [w if rng.random() > 0.1 else "other" for w in words]

    docs, expected = [], set()
    for d in range(60):
        i = rng.randrange(30)
        w = items[i].split()
        kind = d % 6
        if kind == 0:
            text, hit = f"{noise(30)} {items[i].upper()}\n{noise(5)}", True
        elif kind == 1:
            text, hit = f"{noise(10)} {'  '.join(w[:len(w) * 2 // 3])} , {noise(20)}", True
        elif kind == 2:
            text, hit = f"{' '.join(w[:20])}. {noise(25)}. {' '.join(w[20:])}", True
        elif kind == 3:
            text, hit = f"{noise(20)} {' '.join(w[:len(w) // 4])} {noise(20)}", False
        elif kind == 4:
            text, hit = noise(80), False
        else:
            text, hit = " ".join(w[:12] + worn(w[12:])), True
        docs.append((d, text, "clash"))
        if hit:
            expected.add((d, i))
    df = spark.createDataFrame(docs + docs[:3] + [(100, None, ""), (101, "", ""), (None, items[0], ""), (102, noise(20000), "")], "doc_id long, text string, item_id string")
    held = spark.createDataFrame([(k, v) for k, v in items.items()] + [(200, None), (201, ""), (202, "two words"), (None, "x")], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(df, held).collect()} == expected
    assert leakage.leaked(df.limit(0), held).count() == 0 and leakage.leaked(df, held.limit(0)).count() == 0


def test_prefix_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    common = "according to the office of the governor"
    items = [(i, f"{common} {item(rng)}") for i in range(12)]
    docs = [(i, f"{item(rng)} {common} {t if i % 2 else ' '.join(t.split()[:30])}") for i, t in items] + [(50 + i, f"{common} {item(rng)}") for i in range(40)]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    hasher, expected = leakage.Hasher(), set()
    for i, text in items:
        n, own = hasher.shingles(text)
        at = {}
        for k, g in enumerate(own.tolist()):
            at.setdefault(g, []).append(k)
        for d, t in docs:
            expected |= {(d, i)} if leakage.holds(at, n, hasher.shingles(t)[1].tolist(), list(range(10_000))) else set()
    assert {(i, i) for i, _ in items} <= expected
    assert {tuple(r) for r in leakage.leaked(df, held).collect()} == expected
    monkeypatch.setattr(leakage, "TABLE_BITS", 8)  # a full table lets all shingles through
    assert {tuple(r) for r in leakage.leaked(df, held).collect()} == expected


def test_short_and_spaceless_items(spark):
    items = {
        1: "Besk fell before noon", 2: "The bridge at Dorr was mined", 3: "兵士たちは夜明け前に橋を爆破した。市場は閉まったままだった。", 4: "政府军在黎明前封锁了通往维什塔的公路。没有组织宣称负责。",
        5: "ทหารรัฐบาลปิดสะพานไปเวชตาก่อนรุ่งสาง ไม่มีใครอ้างความรับผิดชอบ", 6: "Soft\u00adhyphens hide in\u200b these Words, too",
    }
    docs = [(i, f"Something else stood here. 今日は雨だった。 {t} And more text follows it, 他是医生。", "clash") for i, t in items.items()]
    docs += [(20, "今日は市場が開いた。兵士は帰った。橋は無事だ。", ""), (21, "政府军今天撤退。公路重新开放。", ""), (22, "softhyphens HIDE in these words too", ""), (23, "Besk fell", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    held = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(df, held).collect()} == {(i, i) for i in items} | {(22, 6)}


def test_packing(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [rng.choice([0, 5, 5, 5, 40, 63, 64, 99, 100, 101, 250, rng.randint(0, 120)]) for _ in range(500)]
    docs = [(i, "é" * (s // 2) + "x" * (s % 2), "clash") for i, s in enumerate(sizes)] + [(1000, None, ""), (None, "x", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_tokens string")
    rows = packing.packed(df, 100).collect()
    fill, per = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append((r.piece_no, r.n_tokens))
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    for i, s in enumerate(sizes):
        assert sum(n for _, n in per[i]) == s + 1 and (len(per[i]) == 1) == (s + 1 <= 100)
    assert per[1000] == [(0, 1)] and None not in per
    spaces = []
    for n in sorted((n for p in per.values() for _, n in p), reverse=True):
        fits = [k for k, x in enumerate(spaces) if x >= n]
        if fits:
            spaces[min(fits, key=lambda k: spaces[k])] -= n
        else:
            spaces.append(100 - n)
    assert len(fill) <= len(spaces)
    assert packing.fill_report(packing.packed(df, 100), 100).first().n_containers == len(fill)
    assert packing.packed(df.limit(0), 100).count() == 0
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", 0)
    monkeypatch.setattr(packing, "LEAST_PARTS", 3)
    other = packing.packed(df, 100).collect()
    assert len({r.container_id for r in other}) == len(fill) and sum(r.n_tokens for r in other) == sum(fill.values())


def test_plan_places_every_item_once():
    rng = random.Random(5)
    for _ in range(30):
        histogram = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(12)}
        slots = packing.plan(histogram, 50)
        load = {}
        for size, low, high, first, each in slots:
            for rank in range(low, high + 1):
                c = first + (rank - low) // each
                load[c] = load.get(c, 0) + size
        assert max(load.values()) <= 50
        for size, n in histogram.items():
            ranks = sorted(r for s, low, high, *_ in slots if s == size for r in range(low, high + 1))
            assert ranks == list(range(n))
