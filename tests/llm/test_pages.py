import datetime as dt
import random

import pytest

from weftline.llm import langtags, lines, mainbody, residue, siteblocks

STORY = [
    "Residents of {a} blocked the fuel convoy for {b} after talks in {c} collapsed. Medics in {a} buried {n} people near the old mill.",
    "A patrol of {a} denied any part in the raid on {b}, with {n} vehicles damaged. Nobody from {c} has claimed responsibility.",
    "Les habitants de {a} ont fermé le pont vers {b} avant l'aube. Des combattants de {c} ont libéré {n} otages pendant la récolte.",
    "Regierungstruppen sperrten die Brücke nach {a}, während der Markt in {c} geschlossen blieb. Ärzte aus {b} begruben {n} Menschen.",
    "Жители посёлка {a} перекрыли дорогу на {b} после срыва переговоров. Врачи больницы {c} похоронили {n} человек ещё до рассвета.",
]
MENU = ["Home", "Markets", "Sign in", "Weather", "Last updated: {n}:12, {n} May 2021", "Share (f) (t) (w)", "All rights reserved Harlon Post {n}", "Most read: KLF swaps captives at {a} and {b}", "#{a}, KLF, {b}, BDA"]
ERRORS = ["404 Not Found\nThe page you requested could not be found. Code {n}", "Please enable JavaScript to view this page. Error {n}", "{{{{headline}}}}\n{{{{body_html}}}} {n}", "Access denied. Your address has been blocked by our security service. Ray {n}"]
PLACES = [a + b for a in ("Besk", "Tolv", "Dorr", "Harl", "Mirs", "Osta") for b in ("ina", "umo", "ek", "ar")]
SCHEMA = "globaleventid long, domain string, sqldate int, http_status int, content_type string, article_language string, text string, lang string, scraped_at timestamp"


def fill(rng, text):
    a, b, c = rng.sample(PLACES, 3)
    return text.format(a=a, b=b, c=c, n=rng.randint(2, 28))


@pytest.fixture(scope="module")
def truth():
    rng = random.Random(11)
    rows, empty, furniture, languages = [], set(), set(), {}
    codes = ["en", "en", "fr", "de", "ru"]
    for i in range(260):
        site = rng.choice(["harlon-post.example", "besk-daily.example", "tolvapress.example", None])
        if i % 13 == 0:
            text = "\n".join([*(["Home", "Markets"] if i % 2 else []), fill(rng, rng.choice(ERRORS))])
            empty.add(i)
        else:
            k = rng.randrange(5)
            story = [fill(rng, STORY[k]) for _ in range(3)]
            languages[i] = {codes[k]}
            if i % 7 == 0:
                other = rng.randrange(5)
                story.append(fill(rng, STORY[other]))
                languages[i].add(codes[other])
            top, tail = [fill(rng, x) for x in MENU[:5]], [fill(rng, x) for x in MENU[5:]]
            text = "\n".join([*top, "", *story, *tail])
            furniture |= {(i, n) for n in [*range(len(top)), *range(len(top) + 1 + len(story), len(top) + 1 + len(story) + len(tail))]}
        label = "en: English" if i % 2 else None
        rows += [(i, site, 20200101, 200, "text/html", label, text, "clash", dt.datetime(2024, 1, 1))] * (2 if i % 10 == 0 else 1)
    rows += [(900, None, None, None, None, None, None, None, None), (901, "a.example", None, None, None, None, "", None, None), (902, "a.example", None, None, None, None, " \n ", None, None),
             (None, "a.example", 1, 1, "x", "x", "Home", None, None), (903, "harlon-post.example", 1, 200, "x", "en", "\n".join(fill(rng, STORY[0]) for _ in range(3000)), None, None)]
    return rows, empty, furniture, languages


@pytest.fixture(scope="module")
def articles(spark, truth):
    return spark.createDataFrame(truth[0], SCHEMA)


@pytest.fixture(scope="module")
def models(articles):
    return langtags.fit_on(articles)


def test_no_story_pages(articles, truth, models):
    got = {r[0] for r in residue.no_story_articles(articles, models[0]).collect()}
    assert got == truth[1]


def test_furniture_lines(articles, truth, models):
    got = {tuple(r) for r in mainbody.furniture_lines(articles, models[0]).collect()}
    right = len(got & truth[2])
    assert right / len(got) > 0.97 and right / len(truth[2]) > 0.97
    body = {r[0]: r[1] for r in mainbody.main_text(articles, models[0]).collect()}
    assert body[next(iter(truth[1]))] == "" and "Sign in" not in body[1] and len(body[903]) > 100_000


def test_repeats_are_counted_beyond_the_sample(spark, articles, truth, monkeypatch):
    notice = "Our rural desk closes at noon on market days"
    tail = [(2000 + i, "ostekvalley.example", 20200101, 200, "text/html", "en", f"{notice}\n{fill(random.Random(i), STORY[0])}", "clash", dt.datetime(2024, 1, 1)) for i in range(6)]
    both = articles.unionByName(spark.createDataFrame(tail, SCHEMA))
    whole = mainbody.keyed_and_sample

    def fewer(a):
        keyed, sample = whole(a, 60)
        return keyed, [r for r in sample if r[0] != "ostekvalley.example"]

    monkeypatch.setattr(mainbody, "keyed_and_sample", fewer)
    model = mainbody.fit_on(both)
    assert model.repeats(lines.line_key(notice)) and model.repeated == mainbody.repeated_keys([(r[1], r[6]) for r in [*truth[0], *tail]])
    once = spark.createDataFrame([(*tail[0][:6], f"Related: item {'abcdef'[i] * 9}\n{tail[0][6]}", *tail[0][7:]) for i in range(6)], SCHEMA)
    assert not mainbody.corpus_repeats(mainbody.keyed_pages(once))  # one story published again and again, with other teasers


def test_repeats_are_known_at_any_length():
    notice = "This site and the firms it works with place trackers on your device so that your choices are kept; you may agree or set limits at any time."
    model = mainbody.PageModel()
    model.repeated = mainbody.repeated_keys([("a.example", f"{notice}\n{i * 'x'}") for i in range(1, 6)])
    wide = "   ".join(notice.split())
    assert len(wide) > 160 and model._block(notice, "")[0][3] == model._block(wide, "")[0][3] == 3.0 and model._block(2 * notice, "")[0][3] == 0.0
    assert model._block("  ".join(("Harlon Post " + notice).split()) + 90 * " " + ".", "harlonpost")[0][6] == 1.0


def test_languages(articles, truth, models):
    got = {}
    for i, lang in langtags.wrong_or_mixed(articles, models).collect():
        got.setdefault(i, set()).add(lang)
    expected = {i: langs for i, langs in truth[3].items() if len(langs) > 1 or i % 2 == 0 or langs != {"en"}}
    same = sum(got.get(i) == v for i, v in expected.items())
    assert same / len(expected) > 0.97 and len(set(got) - set(expected)) <= 3
    parts = langtags.story_paragraphs(articles, models).first()
    assert sum(p.n_words for p in parts.parts) == parts.n_words and 0 <= parts.confidence <= 1


def test_switch_inside_a_paragraph(models):
    words, voice = langtags.words_and_voice("Residents of Besk blocked the fuel convoy after the talks. “Les habitants de Tolva ont fermé le pont avant l'aube.”")
    assert voice is not None and voice.sum() == 10
    p = models[1].posteriors([models[1].word_ids(words)])[0]
    assert langtags.LANGUAGES[p[voice].mean(0).argmax()] == "en" and langtags.LANGUAGES[p[~voice].mean(0).argmax()] == "fr"


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    f = langtags.LanguageField()
    rng = np.random.default_rng(2)
    n = len(langtags.LANGUAGES)
    f.emit[:3] = rng.random((3, n))
    f.steps = rng.random((n, n)).astype(np.float32)
    f.steps /= f.steps.sum(1, keepdims=True)
    got = f.posteriors([[0, 1, 2], [2], []])
    total = np.zeros((3, n))
    for path in itertools.product(range(n), repeat=3):
        w = f.emit[0][path[0]] * f.steps[path[0], path[1]] * f.emit[1][path[1]] * f.steps[path[1], path[2]] * f.emit[2][path[2]]
        for t, s in enumerate(path):
            total[t, s] += w
    assert np.allclose(got[0], total / total.sum(1, keepdims=True), atol=1e-4) and got[2].shape == (0, n)


def test_repeated_lines_equal_brute_force(articles, truth, models):
    got = {(r[0], r[2]) for r in siteblocks.repeated_lines(articles, model=models[0]).collect()}
    few = {(r[0], r[2]) for r in siteblocks.boilerplate_lines(articles, model=models[0]).collect()}
    holders, groups, places = {}, {}, []
    for i, site, *_, text, _, _ in truth[0]:
        if i is None or site is None or not text or i in truth[1]:
            continue
        cluster = mainbody.keys_and_cluster(text)[2]
        for n, line in enumerate(text.split("\n")):
            if key := lines.line_key(line):
                holders.setdefault((site, key), set()).add(i)
                groups.setdefault((site, key), set()).add(cluster)
                places.append((i, n, site, key))
    assert got == {(i, n) for i, n, site, key in places if len(holders[site, key]) >= 5} and got
    assert not few  # all of one day
    cleaned = {r[0]: r[1] for r in siteblocks.without_lines(articles, siteblocks.repeated_lines(articles, least_clusters=5, model=models[0])).collect()}
    gone = {(i, n) for i, n, site, key in places if len(groups[site, key]) >= 5}
    assert "blocked" in cleaned[903] and gone
    for i, *_, text, _, _ in truth[0]:
        if i in (1, 2, 7, 903):
            assert cleaned[i] == "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone)


def test_a_story_published_again_is_no_boilerplate(spark, articles, models):
    rng = random.Random(3)
    story = "\n".join(fill(rng, STORY[0]) for _ in range(3))
    again = [(3000 + i, "besk-daily.example", 20200101 + i, 200, "text/html", "en", f"Read also: {'qwertzuiopasdfghjklm'[i] * 12}\n{story}\nOur rural desk closes at noon", "clash", dt.datetime(2024, 1, 1)) for i in range(20)]
    other = [(4000 + i, "besk-daily.example", 20210101 + i, 200, "text/html", "en", f"{fill(rng, STORY[1])}\nOur rural desk closes at noon", "clash", dt.datetime(2024, 1, 1)) for i in range(6)]
    both = articles.unionByName(spark.createDataFrame(again + other, SCHEMA))
    got = {(r[0], r[2]) for r in siteblocks.boilerplate_lines(both, models[0]).collect()}
    assert {(i, n) for i, n in got if 3000 <= i < 3020} == {(3000 + i, 4) for i in range(20)}
    assert {(i, n) for i, n in got if i >= 4000} == {(4000 + i, 1) for i in range(6)}
    found = {(r[0], r[2]) for r in siteblocks.repeated_lines(both, model=models[0]).collect()}
    assert {(3000, n) for n in (1, 2, 3, 4)} <= found and (3000, 0) not in found
    cleaned = {r[0]: r[1] for r in siteblocks.without_lines(both, siteblocks.boilerplate_lines(both, models[0])).collect()}
    assert cleaned[3000].endswith(story) and cleaned[3000].startswith("Read also")


def test_line_keys():
    same = ["Updated 26 July 2020", "UPDATED: 03.08.2021", "  updated   1 May 2022 ...", "» Updated 2022-01-01"]
    assert len({lines.line_key(x) for x in same}) == 1 and lines.line_key(" \r") == "" and lines.line_key("更新 2020年5月1日") == lines.line_key("更新 3.4.2021")
    assert lines.line_key("Views: 5") != lines.line_key("Reads: 5") and lines.line_key("—") == "—"
    assert lines.mend("trÃ¨s") == "très" and lines.mend("plain") == "plain" and lines.mend("très") == "très"


def test_empty_tables(spark, models):
    none = spark.createDataFrame([], SCHEMA)
    for f in (mainbody.furniture_lines, residue.no_story_articles, siteblocks.repeated_lines, siteblocks.boilerplate_lines, langtags.wrong_or_mixed, mainbody.main_text, langtags.story_paragraphs):
        assert f(none).count() == 0


def plain_key(line):
    """What ``line_key`` says, letter by letter."""
    import re
    import unicodedata

    text = line.lower() if line.isascii() else unicodedata.normalize("NFC", line.upper().casefold())
    text = re.sub(r"(?<=\d)\s*[年月日号號時时分秒]", " ", text.replace("\x00", " "))
    parts = "".join("\x00" if c.isdecimal() else c for c in text).split("\x00")
    out = []
    for i, part in enumerate(parts):
        words = re.findall(r"[^\W_]+", part)
        if words and i > 0 and words[0] in lines.FILLED:
            words = words[1:]
        if words and i < len(parts) - 1 and words[-1] in lines.FILLED:
            words = words[:-1]
        out.append("".join(words))
    return re.sub("\x00+", "#", "\x00".join(out)) or line.strip()


def calls_of(f, *args):
    import sys

    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def test_line_keys_equal_plain_ones():
    rng = random.Random(8)
    some = [*lines.FILLED, *(m.upper() for m in lines.MONTHS), *"0123456789" * 8, *["2021", "12:30", "٣", "१२", "𝟙", "²", "年", "月", "日", "_", " ", " ", ".", "/", "\x00", "\t", "ß", "İ", "é", "é", "का", "×", "÷", "“", "—", "x", "maymay", "한"] * 3]
    for _ in range(20_000):
        line = "".join(rng.choice(some) for _ in range(rng.randint(1, 9))) + rng.choice(["", " Besk", " Жители"])
        assert lines.line_key(line) == plain_key(line), repr(line)


def test_keys_of_lines_with_numbers_are_made_in_few_steps():
    for line in ("A patrol denied that 14 vehicles were damaged on 3 May near the old mill and that 120 people had left before 6 pm for the valley.", "Жители сообщили, что 14 машин сгорели 3 мая у старой мельницы, а 120 человек ушли до 18 часов в соседнюю долину на севере."):
        assert len(line) >= 120 and calls_of(lines.line_key, line) < 60


def test_link_marks():
    assert mainbody.link_marks("Home | News · Sport - Weather - http://a.example www.b.example, #tag") == 8
    assert mainbody.link_marks("well-known and/or - - done") == 1 and mainbody.link_marks("https://x") == 1 and mainbody.link_marks("") == 0


def test_leading_languages_are_those_of_the_distributions(models):
    field = models[1]
    rng = random.Random(4)
    texts = [fill(rng, rng.choice(STORY)) + (" “" + fill(rng, rng.choice(STORY)) + "”" if i % 3 == 0 else "") for i in range(60)]
    read = [langtags.words_and_voice(x) for x in texts]
    ids, voices = [field.word_ids(w) for w, _ in read], [v for _, v in read]
    found = field.posteriors(ids)
    assert any(v is not None for v in voices)
    assert field.leading(ids, voices) == [int((p if v is None else p[v]).sum(0).argmax()) for p, v in zip(found, voices)]
