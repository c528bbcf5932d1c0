import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import dates, maths, pages, text as t, urls


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_text_columns_on_edge_rows(spark):
    rows = [(None,), ("",), ("  ÉTÉ_été, Straße!  ",), ("a b c d e f",)]
    x = F.col("x")
    got = values(spark, rows, "x string", t.hash_form(x), F.size(t.tokens(x)), F.size(t.shingles(t.tokens(x))), t.word_count(x), t.sentence_count(x), t.text_key(x).isNull())
    assert [g[0] for g in got] == ["", "", "été été straße", "a b c d e f"]
    assert [g[1] for g in got] == [0, 0, 3, 6] and [g[2] for g in got] == [0, 0, 0, 2]
    assert [g[3] for g in got] == [0, 0, 3, 6] and [g[5] for g in got] == [True, True, False, False]


def test_keys_of_names(spark):
    rows = [("The Al-Qaeda & Sons",), ("P.K.K.",), ("M23",), (None,)]
    x = F.col("x")
    got = values(spark, rows, "x string", t.phrase_key(x), t.compact_key(x), t.acronym_key(x))
    assert got == [("al qaeda and sons", "alqaedaandsons", None), ("p k k", "pkk", "pkk"), ("m23", "m23", None), ("", "", None)]
    split = values(spark, [("A; B aka C / D",)], "x string", t.split_terms(x))
    assert list(split[0][0]) == ["A", "B", "C", "D"]


def test_mended_and_flags(spark):
    wrong = "très été déjà là".encode().decode("latin-1")
    rows = [(wrong,), ("plain",), (None,), ("ØÙÐÑ " * 10,), ("“quoted” – déjà vu, " + "été très là ".encode().decode("cp1252", "ignore") * 3,)]
    got = values(spark, rows, "x string", t.mended(F.col("x")), t.looks_misdecoded(F.col("x")))
    assert got[:4] == [("très été déjà là", True), ("plain", False), (None, False), ("", True)] and got[4][1]
    story = "The convoy left the town at dawn on Friday. Subscribe to our newsletter now, please do. Nobody was hurt in the raid at all."
    kept = values(spark, [(story,), ("Access denied for this page of the site.",), (None,), ("short",), ("Нападение произошло на рассвете у моста. Никто не пострадал в этот день.",)], "x string", t.content_sentences(F.col("x")))
    assert kept[0][0] == "The convoy left the town at dawn on Friday. Nobody was hurt in the raid at all." and kept[1][0] == "" and kept[2][0] is None and kept[3][0] == "short" and kept[4][0].startswith("Нападение")
    flags = t.quality_flags(F.col("x"))
    got = values(spark, [("",), ("Subscribe newsletter cookie privacy. " * 40,)], "x string", flags["quality_bad_score"], flags["quality_bad_reason"])
    assert got[0] == (1, "short_text,few_sentences") and "boilerplate" in got[1][1]


def test_join_unique_and_chunks(spark):
    got = values(spark, [(["b", None, " a", "a", ""],)], "x array<string>", t.join_unique(F.col("x")), t.join_unique(F.col("x"), 1))
    assert got == [("a; b", "a; ... (+1)")]
    whole = "One two three. Four five six. " + "x" * 25
    cut = t.chunks(whole, 12)
    assert all(len(c) <= 12 for c in cut) and "".join(cut).replace(" ", "") == whole.replace(" ", "")
    assert t.chunks(None, 5) == [] and t.chunks("", 5) == []
    assert t.chunks("One. Two words that are long. Six.", 12) == ["One.", "Two words", "that are", "long.", "Six."]
    assert t.chunks("a bb " + "x" * 7 + " c dd. E.", 5) == ["a bb", "xxxxx", "xx", "c dd.", "E."] and t.chunks("A. B. C. D.", 5) == ["A. B.", "C. D."]


def test_urls(spark):
    rows = [("HTTP://WWW.A.example/x/?utm_source=1&q=2&b=#f",), ("https://a.example:80/p.pdf?x",), ("no url",), (" ",), (None,), ("http://a.example/i.PNG",)]
    u = F.col("u")
    got = values(spark, rows, "u string", urls.normal_url(u), urls.host(u), urls.is_pdf(u), urls.is_page(u))
    assert got[0] == ("https://a.example/x?q=2", "a.example", False, True)
    assert got[1][1:3] == ("a.example:80", True) and got[2][0] == "no url" and got[3][0] is None and got[4][0] is None and got[5][3] is False


def test_dates(spark):
    rows = [("20200229",), ("20210229",), ("20190101.0",), ("x",), (None,)]
    d = dates.day_of(F.col("x"))
    got = values(spark, rows, "x string", d.cast("string"), dates.block_start(d, 2).cast("string"))
    assert [g[0] for g in got] == ["2020-02-29", None, "2019-01-01", None, None]
    assert got[2][1] == "2018-12-31" and got[0][1] == "2020-02-24"


def test_maths():
    assert maths.two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert maths.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert maths.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert maths.chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert math.isnan(maths.pooled_kappa(1.0, 1.0)) and maths.pooled_kappa(0.84, 0.577) == pytest.approx(0.6217, abs=1e-3)
    with pytest.raises(ValueError):
        maths.calibrated(F.lit(0.5), 0.2, 0.3)


def test_pages(spark):
    html = "<html><nav>Menu</nav><article><h1>T</h1><p>" + "word " * 60 + "</p><script>x</script></article></html>"
    df = spark.createDataFrame([(1, html), (2, "<p>short</p>"), (3, None)], "k long, html string")
    got = {r.k: r for r in pages.extracted(df, "k", "html").collect()}
    assert got[1].text.startswith("T\nword") and "Menu" not in got[1].text and got[2].failure == "too_short" and got[3].failure == "no_html"
