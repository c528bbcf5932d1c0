import math

import numpy as np
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import acquire, dedup, entities, grid_series, labeling, latent, measures, panel, regress


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


GED = "id long, date_start string, side_a_new_id string, best double, loaded_at timestamp, country string"


def test_series_edges(spark):
    stamp = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([
        (1, "2020-01-05", "7", 3.0, stamp, None), (1, "2020-03-05", "7", 4.0, stamp + dt.timedelta(days=1), "x"), (2, "20200105", " 7.0", 1.0, stamp, "x"), (2, "20200105", " 7.0", 1.0, stamp, "x"),
        (3, "05.06.2020", "7", float("nan"), stamp, "x"), (4, "2020-13-01", "7", 1.0, stamp, "x"), (5, "2020-05-05T10:00:00", "8", 2.0, None, "x"), (6, None, "8", 2.0, stamp, "x"),
        (7, "2020-05-05", "", 2.0, stamp, "x"), (8, "2020-05-05", None, 2.0, stamp, "x"), (9, "2017-12-31", "8", 2.0, stamp, "x"), (10, "2020-05-05", "8", -1.0, stamp, "x"), (None, "01.07.2020", "8", 5.0, stamp, "x"),
    ], GED)
    series = grid_series.regular_series(events)
    got = {(r.actor_id, r.month_key): r for r in series.collect()}
    assert sorted(got) == [(7, "2020-01"), (7, "2020-02"), (7, "2020-03"), (8, "2020-05"), (8, "2020-06"), (8, "2020-07")]
    assert got[7, "2020-01"].reading == 1.0 and got[7, "2020-03"].reading == 4.0 and got[7, "2020-02"].is_missing and got[7, "2020-02"].level_sd > 0
    assert rows(grid_series.missing_months(series)) == [(7, "2020-02"), (8, "2020-06")]
    assert grid_series.regular_series(events.limit(0)).count() == 0


def test_smoother_holds_a_constant_and_bounds_gaps():
    level, sd, slope = grid_series.smooth(np.array([0.0, 1, 2, 9]), np.array([2.0, 2, 2, 2]), np.arange(10.0))
    assert np.allclose(level, 2, atol=0.05) and sd[5] > sd[1] and abs(slope).max() < 0.05


def jaccard_pairs(texts, similar):
    shingle = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = {k: (len(v.split()), shingle(v.split())) for k, v in texts.items()}
    return {(a, b) for a in sets for b in sets if a < b and sets[a][1] and sets[b][1] and max(sets[a][0], sets[b][0]) <= 1.6 * min(sets[a][0], sets[b][0])
            and len(sets[a][1] & sets[b][1]) / len(sets[a][1] | sets[b][1]) >= similar}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "COMMON", 5)
    monkeypatch.setattr(dedup, "CROWDED", 8)
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{v}" for v in rng.integers(0, 400, 90)) for _ in range(6)]
    common = " ".join(f"c{v}" for v in range(95))
    texts = {}
    for i in range(40):
        words = (base[i % 6] if i % 3 else common).split()
        for _ in range(int(rng.integers(0, 3))):
            words[int(rng.integers(0, len(words)))] = f"n{int(rng.integers(0, 50))}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(100, None), (101, ""), (102, texts[1].upper() + "!"), (103, "short text")], "doc_id long, text string")
    classes = dedup.exact_classes(df)
    found = {r.doc_id: r.class_id for r in classes.collect()}
    assert found[102] == found[1] and found[100] == 100 and found[101] == 101
    firsts = {found[k]: v for k, v in texts.items()}
    got = {(r.id_1, r.id_2) for r in dedup.near_pairs(dedup.representatives(df)).collect()}
    assert got == jaccard_pairs(firsts, 0.85) and got
    linked = {r.doc_id: (r.class_id, r.n_links) for r in dedup.near_classes(df).collect()}
    assert set(linked) == set(texts) | {100, 101, 102, 103}
    for a, b in got:
        assert linked[a][0] == linked[b][0] and linked[a][1] >= 1
    kept = dedup.canonical(df, dedup.near_classes(df)).where("is_canonical").groupBy("class_id").count().where("count > 1")
    assert kept.count() == 0
    assert dedup.near_classes(df.limit(0)).count() == 0


def test_near_pairs_leave_texts_and_shingles_out_of_the_checkpoint_folder(spark):
    """What the search writes grows with texts and pairs, not with shingles."""
    import pathlib

    spark.range(1).checkpoint()
    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    rng = np.random.default_rng(7)
    words = [[f"w{v}" for v in rng.integers(0, 10 ** 6, 1500)] for _ in range(60)]
    rows = [(2 * i + late, " ".join(w[9 * late:])) for i, w in enumerate(words) for late in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = written()
    got = {(r.id_1, r.id_2, r.similarity) for r in dedup.near_pairs(dedup.representatives(df)).collect()}
    assert got == {(2 * i, 2 * i + 1, round(1487 / 1496, 4)) for i in range(60)}
    assert written() - before < sum(len(x) for _, x in rows) / 4
    copies = df.unionByName(df.selectExpr("doc_id + 1000 as doc_id", "text"))
    assert {(r.id_1, r.id_2) for r in dedup.near_pairs(dedup.representatives(copies)).collect()} == {x[:2] for x in got}


def test_components_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "id_1 long, id_2 long")
    got = {r.id: r.class_id for r in dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63


def test_ranking_and_joins(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (None, "c", 1)], "k long, v string, n int")
    assert rows(acquire.latest(df, ["k"], [F.col("n").desc()])) == [(1, "b", 3), (None, "c", 1)]
    dim = spark.createDataFrame([(1, "x")], "k long, d string")
    assert len(rows(acquire.left_one(df, dim, ["k"]))) == 3
    with pytest.raises(Exception, match="several rows"):
        acquire.left_one(df, dim.union(dim), ["k"]).collect()


def test_candidates_prefer_the_own_url(spark):
    events = spark.createDataFrame([(1, "http://a.example/x"), (2, "http://c.example/i.png"), (3, None)], "globaleventid long, used_url string")
    mentions = spark.createDataFrame([(1, "https://www.a.example/x/", 2, 10, 100, 5), (1, "http://b.example/1", 1, 50, 5000, 1), (1, "http://b.example/2", 1, 40, 5000, 1), (2, "http://d.example/p.pdf", 1, 99, 1, 1)],
                                     "globaleventid long, mentionidentifier string, mentiontype int, confidence int, mentiondoclen int, sentenceid int")
    got = rows(acquire.url_candidates(events, mentions).select("globaleventid", "url", "candidate_rank"))
    assert got == [(1, "https://a.example/x", 1), (1, "https://b.example/1", 2)]


def test_kappa_rates_and_fdr(spark):
    cells = [("yes", "yes", 73), ("no", "yes", 18), ("yes", "no", 9), ("no", "no", 59)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string").withColumn("g", F.lit(1))
    c = measures.confusion(df, ["g"], "yes").first()
    assert (c.tp, c.tn, c.fp, c.fn) == (73, 59, 18, 9) and c.recall == pytest.approx(0.8902, abs=1e-4) and c.fpr == pytest.approx(0.2338, abs=1e-4)
    assert c.f1 == pytest.approx(0.8439, abs=1e-4) and c.kappa == pytest.approx(0.6589, abs=1e-4)
    assert measures.kappa(df, ["g"]).first().kappa == pytest.approx(c.kappa)
    p = spark.createDataFrame([("f", "a", 0.1248), ("f", "b", 0.0152), ("f", "c", 0.6041), ("f", "d", None)], "fam string, n string, p double")
    got = {r.n: r.p_fdr for r in measures.bh_adjusted(p, ["fam"], "p", ["n"]).collect()}
    assert got["a"] == pytest.approx(0.1872) and got["b"] == pytest.approx(0.0456) and got["c"] == pytest.approx(0.6041) and got["d"] is None


def brute_hac(x, e, keys, periods, lags):
    s = x * e[:, None]
    meat = s.T @ s
    at = {(k, p): i for i, (k, p) in enumerate(zip(keys, periods))}
    for lag in range(1, lags + 1):
        g = sum((np.outer(s[i], s[at[k, p - lag]]) for (k, p), i in at.items() if (k, p - lag) in at), np.zeros((x.shape[1],) * 2))
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return meat


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(1)
    keys, periods = np.repeat([1, 2, 3], 30), np.tile(np.arange(30), 3)
    keep = rng.random(90) > 0.2
    d = pd.DataFrame({"k": keys, "t": periods, "a": rng.normal(size=90), "b": rng.normal(size=90), "z": 1.0})[keep]
    d["y"] = 1 + 2 * d.a - d.b + rng.normal(size=len(d))
    f = regress.fit(spark.createDataFrame(d), "y", ["a", "b", "z"], "k", "t", 4, signals=["a", "b"])
    assert f.names == ["a", "b", "intercept"]
    x = np.column_stack([d.a, d.b, np.ones(len(d))])
    beta = np.linalg.lstsq(x, d.y, rcond=None)[0]
    bread = np.linalg.inv(x.T @ x)
    cov = bread @ brute_hac(x, (d.y - x @ beta).to_numpy(), d.k.tolist(), d.t.tolist(), 4) @ bread * len(d) / (len(d) - 3)
    assert np.allclose(f.beta, beta) and np.allclose(f.cov, cov)
    assert f.diagnostics["r2"] == pytest.approx(1 - ((d.y - x @ beta) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum())
    v = regress.vifs(f)
    assert v["a"] == pytest.approx(1 / (1 - np.corrcoef(d.a, d.b)[0, 1] ** 2), rel=1e-6)
    assert regress.corrected(f, "a", 0.0, 1.0)["bca"] == pytest.approx(f.beta[0])


def test_validation_draws_equal_fits_of_calibrated_panels(spark):
    rng = np.random.default_rng(5)
    d = pd.DataFrame([(k, t) for k in range(6) for t in range(30) if (k + t) % 7], columns=["k", "t"])
    d["n"], d["z"], d["flat"] = rng.integers(40, 90, len(d)), rng.normal(size=len(d)), 1.0
    d["share"] = rng.binomial(d.n, 0.5) / d.n
    d["y"] = d.share + 0.3 * d.z + rng.normal(size=len(d))
    rates = np.array([[0.9, 0.1], [np.nan, np.nan], [0.75, 0.2]])
    draws = regress.validation_draws(spark.createDataFrame(d), "y", "share", ["z", "flat"], "k", "t", rates, 3, "n")
    assert len(draws) == 2
    for got, (tpr, fpr) in zip(draws, rates[[0, 2]]):
        c = spark.createDataFrame(d.assign(share=((d.share - fpr) / (tpr - fpr)).clip(0, 1)))
        mean, square = c.selectExpr("avg(share)", "avg(share * share)").first()
        one = regress.corrected(regress.fit(c, "y", ["share", "z"], "k", "t", 3), "share", regress.index_omega(mean, square, tpr, fpr), regress.count_kappa(c, "n"))
        assert got == pytest.approx(one, nan_ok=True)
    name, n, point, spread, hac, both, *_ = regress.combined_errors(draws)[0]
    assert (name, n) == ("calibrated", 2) and spread > 0 and both == pytest.approx((hac**2 + spread**2) ** 0.5)


def test_residuals_contrast_season_and_absolute_errors(spark):
    rng = np.random.default_rng(9)
    d = pd.DataFrame([(k, t) for k in "ab" for t in range(40)], columns=["k", "t"])
    d["x"], d["y"] = rng.normal(size=80), rng.normal(size=80)
    d["fore"], d["back"] = 2 * d.x + rng.normal(size=80), 0.5 * d.x
    df = spark.createDataFrame(d)
    f = regress.fit(df, "y", ["x"], "k", "t", 2)
    e = d.y - d.x * f.beta[0] - f.beta[1]
    assert regress.residual_ar1(df, f, "y", "k", "t") == pytest.approx(np.mean([e[d.k == k].autocorr() for k in "ab"]))
    beta, se, _, n = regress.lead_lag_contrast(df, ["x"], {1: "fore", -1: "back"}, "x", "k", "t", 2)
    assert beta == pytest.approx(np.polyfit(d.x, d.fore - d.back, 1)[0]) and se > 0 and n == 80
    last = d[d.t == 39]
    slope, cut = np.polyfit(d.x[d.t < 39], d.y[d.t < 39], 1)
    got = {r.at: r.sae for r in regress.rolling_forecasts(df.withColumnRenamed("t", "at"), "y", ["x"], "at").collect()}
    assert got[39] == pytest.approx(np.abs(last.y - cut - slope * last.x).sum())
    months = np.arange(48.0)
    wave = 3 * np.sin(2 * math.pi * months / 12)
    assert regress.two_group_difference(wave + (months > 20), months > 20, 3, False, months)["difference"] == pytest.approx(1)
    assert regress.two_group_difference(wave + (months > 20), months > 20)["difference"] != pytest.approx(1, abs=0.01)


def test_errors_of_several_classes():
    rates = np.array([[0.9, 0.1], [0.2, 0.8]])
    shares = np.random.default_rng(1).uniform(size=50)
    both = np.column_stack([shares, 1 - shares])
    one = regress.classes_omega(both.mean(0), both.T @ both / 50, rates)
    assert one[0, 0] == pytest.approx(regress.index_omega(shares.mean(), (shares**2).mean(), 0.9, 0.2))
    three = np.random.default_rng(2).dirichlet([1, 1, 1], 50)
    omega = regress.classes_omega(three.mean(0), three.T @ three / 50, np.full((3, 3), 0.1) + 0.7 * np.eye(3))
    assert omega.shape == (2, 2) and np.linalg.eigvalsh(omega).min() >= -1e-12
    f = regress.Fit(["a", "b", "intercept"], np.array([1.0, 2.0, 0.5]), np.eye(3), 50, 1.0, 1.0, 50 * np.eye(3))
    got = regress.corrected_classes(f, ["a", "b"], omega, 1.0)
    assert [got[s]["bca"] for s in "ab"] == pytest.approx(list(np.array([1.0, 2.0]) + omega @ [1.0, 2.0] / math.sqrt(50)))


def test_prompts_hold_whole_texts(spark, tmp_path):
    from weftline.plans import texts

    long = "word " * 4000 + "end"
    one = {"globaleventid": 1, "actor1name": "A", "actor2name": "B", "sqldate": 20200101, "text": long, "scraped_at": dt.datetime(2024, 1, 1)}
    spark.createDataFrame([one]).write.parquet(str(tmp_path / "articles_raw.parquet"))
    assert texts.QUERIES["render_prompt"](spark, str(tmp_path)).first()["prompt"].endswith(long)


def test_latent_models():
    rng = np.random.default_rng(5)
    theta = rng.random(150)
    trials = rng.integers(30, 60, 150).astype(float)
    hits = rng.binomial(trials.astype(int), 0.15 + 0.75 * theta).astype(float)
    c = latent.Counts(trials, hits, 2 * theta + 0.5 + rng.normal(0, 0.2, 150), np.ones((150, 1)), 200, 180, 200, 30)
    f = latent.maximise(c)
    assert f["gamma"] == pytest.approx(2, abs=0.25) and 0 < f["se"] < 0.3 and f["least_eigenvalue"] > 0
    assert latent.maximise(c, True)["log_likelihood"] > f["log_likelihood"] - 2
    with pytest.raises(ValueError):
        latent.Counts(np.array([1.0]), np.array([2.0]), np.array([0.0]), np.ones((1, 1)), 1, 1, 1, 0)
    rates = latent.rate_bootstrap(73, 9, 18, 59, 500, 1)
    assert np.nanmean(rates[:, 0]) == pytest.approx(0.89, abs=0.01)
    assert np.allclose(latent.confusion_inverse(np.eye(3)), np.eye(3))


def test_panel_pieces(spark):
    e = spark.createDataFrame([(1, dt.date(2021, 8, 14), 10, None, 3.0, "A"), (2, dt.date(2021, 8, 15), 20, 10, None, ""), (3, None, 10, 10, 1.0, "B")],
                              "id long, day date, side_a long, side_b long, best double, country string").withColumns({"adm_1": F.lit("r"), "latitude": F.lit(1.0), "longitude": F.lit(2.0), "where_prec": F.lit(1)})
    sides = panel.by_side(e)
    assert len(rows(sides.select("id", "actor_id"))) == 4
    ids = spark.createDataFrame([("k", 10, None, "2021-08-15"), ("k", 20, "2021-08-15", None)], "actor_key string, actor_id long, a string, b string").select("actor_key", "actor_id", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    assert [r[:2] for r in rows(panel.identity_join(sides, ids))] == [("k", 1), ("k", 2)]
    sets = {(r.actor_id, r.month): r.countries for r in panel.lookback_sets(e, 2021 * 12 + 7, 2021 * 12 + 10, 2).collect()}
    assert sets[10, 2021 * 12 + 8] == ["A"] and sets[10, 2021 * 12 + 9] == ["A"] and sets[10, 2021 * 12 + 10] == []
    assert panel.risk_features(panel.first_region(sides)).count() >= 1


def test_labelling(spark):
    df = spark.createDataFrame([(1, "de", "Hallo. Welt."), (2, "en", "x"), (3, None, "y"), (4, "fr", ""), (5, "fr", "bad")], "k long, lang string, text string")
    todo = labeling.translation_queue(df, "lang", "text")
    assert [r.k for r in todo.orderBy("k").collect()] == [1, 5]

    def work(x):
        if x == "bad":
            raise ValueError("no")
        return x.upper()

    got = {r.k: r for r in labeling.outside(todo, work, "k", "text", 6).collect()}
    assert got[1].answer == "HALLO. WELT." and got[5].error.startswith("ValueError")
    assert [r.k for r in labeling.queue(todo, spark.createDataFrame([(1, True), (5, False)], "k long, ok boolean"), ["k"], F.col("ok")).collect()] == [5]
    answers = spark.createDataFrame([(1, '{"a": "Yes"}'), (2, "{oops"), (3, '{"a": "maybe"}')], "k long, answer string")
    assert [r.problem for r in labeling.parsed(answers, "a string", {"a": ["yes", "no"]}).orderBy("k").collect()] == [None, "malformed", "a"]
    words = {"en": "the of and", "fr": "les des et"}
    lang = spark.createDataFrame([("the war of the worlds and more of the same",), ("les uns et les autres, des gens et des choses",), ("x",), (None,)], "t string").select(labeling.function_word_language(F.col("t"), words, 20)).collect()
    assert [r[0] for r in lang] == ["en", "fr", "unknown", "unknown"]


def test_upsert_and_slices(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert rows(entities.upserted(cur, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(entities.slice_by_order(spark.range(10).withColumnRenamed("id", "k"), [F.col("k")], 3, 4)) == [(3,), (4,), (5,), (6,)]
    assert math.isclose(entities.lexicon(spark.createDataFrame([(1, "P.K.K.; The Party aka M23", "government of X")], "id long, a string, b string"), "id", ["a", "b"], "s").count(), 3)

def test_joint_model_with_many_trials():
    """Counts of a large table: no overflow, the share's integral does not depend on the number of nodes, and the coefficient comes out."""
    rng = np.random.default_rng(5)
    theta = rng.uniform(0.1, 0.9, 12)
    trials = rng.integers(50_000, 1_000_000, 12).astype(float)
    hits = np.round(trials * (0.15 + 0.7 * theta))
    y = 2 * theta - 4 + rng.normal(0, 0.05, 12)
    c = latent.Counts(trials, hits, y, np.ones((12, 1)), 2_000_000, 1_700_000, 3_000_000, 450_000)
    p = np.array([2.0, -4.0, np.log(0.05), np.log(0.15 / 0.85), np.log(0.7 / 0.15)])
    assert abs(latent.log_likelihood(p, c) - latent.log_likelihood(p, c, n=200)) < 1e-6
    far = p.copy()
    far[3] = -5_000.0
    assert np.isfinite(latent.log_likelihood(far, c))
    got = latent.maximise(c)
    assert got["converged"] and abs(got["gamma"] - 2) < 0.2 and 0 < got["se"] < 0.2
    draws = latent.chain(c, 3, 300, 300)
    assert np.isfinite(draws).all() and abs(draws[:, 0].mean() - 2) < 0.2
