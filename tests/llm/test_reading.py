"""Prose, features and trees, and held-out accuracy on the sample passages."""

from pathlib import Path

import numpy as np
import pytest

from quernel.llm.reading import LEVELS, STYLE, Trees, counted, features, fit, fit_passages, grades, lexicon, profile, prose, read_passages, style, validate, word_of

EASY = ["The cat is big. I see it.", "My dog ran. It was red.", "He has a hat. We go now.", "Look at it. She is old."]
HARD = ["Epistemological commensurability presupposes intersubjective canonicalization.", "Probabilistic heterogeneity necessitates systematic differentiation.", "Asymptotic parameterization circumscribes teleological interoperability.", "Counterfactual monotonicity problematizes constitutive intentionality."]
PASSAGES = [("en", 1, t) for t in EASY] + [("en", 5, t) for t in HARD]


def test_prose():
    text = "user: ```\nx = 1\n```\nassistant: - sessions/a/b.json\n[10:00:00] INFO a.b ms=1\n{\"id\": 1}\n| a | b |\n# Title\nThe cat sees `code` here.\n用户：你好。\n- src/a.py"
    assert prose(text).split() == ["The", "cat", "sees", "here.", "你好。"]
    assert [word_of(t) for t in ("Cat,", "fooBar", "a1", "x/y", "«Haus»", "--", "ABC")] == ["cat", None, None, None, "haus", None, "abc"]
    assert counted("```\nnever closed")[:3] == (False, {}, 0)
    assert counted("中文字")[0] and dict(counted("中文，字好")[1]) == {"中文": 1, "字好": 1}


def test_style():
    plain = style("The cat is big. The cat is red.", False, counted("The cat is big. The cat is red.")[1])
    long = "Although the cat, which is big, was seen because it is red, it ran. However, dogs sleep."
    hard = style(long, False, counted(long)[1])
    assert len(plain) == len(hard) == STYLE and hard[0] > plain[0] and hard[1] > plain[1] == 0 and hard[3] > plain[3] == 0 and hard[4] > plain[4] == 0 and hard[5] > plain[5] == 0 and plain[6] > hard[6]
    zh = "虽然灯很小，但是红鸟很高。红鸟很高。"
    assert style(zh, True, counted(zh)[1])[3:6] == (0.5, pytest.approx(1 / 12), pytest.approx(1 / 12)) and style("", True, counted("")[1]) == (0.0,) * STYLE
    assert all(np.isfinite(style(t, False, counted(t)[1])).all() for t in ("x", "a b", "." * 1000, "a. " * 100_000))


def test_trees():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(600, 4))
    y = (x[:, 0] > 0.5) * 2.0 + x[:, 1]
    assert np.abs(Trees().fit(x[:500], y[:500]).predict(x[500:]) - y[500:]).mean() < 0.15
    assert np.allclose(Trees().fit(x[:3], y[:3]).predict(x[:3]), y[:3].mean(), atol=1e-6)


def test_features_sum_to_one():
    book = lexicon([counted(t)[1] for t in EASY], [1] * 4)
    x, language, size = features([counted(EASY[0]), counted("")], {"en": book, "de": lexicon([], []), "zh": lexicon([], [])})
    assert x[0, :LEVELS].sum() == pytest.approx(1) and language[0] == 0 and size.tolist() == [7, 0] and np.isfinite(x).all()


def test_grades(spark):
    model = fit(PASSAGES)
    cases = [(1, EASY[1], "s"), (2, HARD[1], "s"), (3, None, "s"), (4, "", None), (5, "```\ncode\n```", None), (6, HARD[0].lower().rstrip("."), "t"), (7, (EASY[0] + " ") * 30_000, "t"), (8, "sessions/a_1/b.json", "t"), (8, HARD[1], "t")]
    df = spark.createDataFrame([(*c, "x", 1, 2.0) for c in cases], "doc_id bigint, text string, source string, lang string, words int, level double")
    got = {r.doc_id: r for r in grades(df, model, ["doc_id", "source"]).where("not (doc_id = 8 and level is not null)").collect()}
    assert got[1].level < 2 < 4 < got[2].level and got[6].level > 3.5 and got[7].level < 2 and got[2].lang == "en"
    assert all(got[k].level is None and got[k].lang is None for k in (3, 4, 5, 8))
    out = grades(df, model, ["doc_id", "source"])
    assert out.count() == 9 and sum(r.documents for r in profile(out).collect()) == 5
    assert grades(df.limit(0), model, ["doc_id"]).count() == 0
    assert grades(df, None, ["doc_id"]).where("level is not null").count() == 0


def test_short_prose_has_a_level(spark):
    model = fit([*PASSAGES, *[("zh", 1, t) for t in ("我有小灯。他很好。", "她有红鸟。水不高。")], *[("zh", 5, t) for t in ("认识论的可通约性以主体间的规范化为前提。", "概率异质性要求系统性的分化与归约。")]])
    texts = ["她有白桥。表很大。", "灯不白。", "user: 船很红。", "好。", "Look.", "* 她有灯。\n* - sessions/viaduct/jade_0gtvs54.json\n* - sessions/station/eager_126m719.json"]
    code = ["x = graph", "let a = b;", "return load(graph);", "if ready {", "import os", "from graph import nodes", "$ make all", "def run(self):", "* - * sessions/a_1/b.json", "- ", "[10:00:00] INFO a.b"]
    df = spark.createDataFrame(list(enumerate(texts + code)), "doc_id int, text string")
    got = {r.doc_id: r for r in grades(df, model, ["doc_id"]).collect()}
    assert [got[k].lang for k in range(len(texts))] == ["zh", "zh", "zh", "zh", "en", "zh"]
    assert all(got[k].level is not None and got[k].words > 0 for k in range(len(texts)))
    assert all(got[len(texts) + k].level is None for k in range(len(code)))
    assert prose("It holds; whatever\nfollows (see below);\nthe end.").split() == "It holds; whatever follows (see below); the end.".split()


def test_prose_in_two_scripts():
    zh = ["我有小灯。他很好。", "她有红鸟。水不高。", "我有红灯。她很高。"]
    hard = "认识论的可通约性以主体间的规范化为前提。概率异质性要求系统性的分化与归约。"
    model = fit([*PASSAGES, *[("zh", 1, t) for t in zh], *[("zh", 5, t) for t in (hard, hard[:20], hard[20:])]])
    texts = [EASY[0], hard, EASY[0] + "\n" + hard, HARD[0] + " " + zh[0], "类别: parser\n" + hard, EASY[1] + " 白桥"]
    level, language, words = model.grade(texts)
    assert level[2] == pytest.approx((level[0] * words[0] + level[1] * words[1]) / (words[0] + words[1])) and words[2] == words[0] + words[1]
    assert level[0] < level[2] < level[1] and level[3] < model.grade([HARD[0]])[0][0]
    assert level[4] == level[1] and words[4] == words[1]
    assert language.tolist() == [0, 2, 2, language[3], 2, 0] and words[5] == 6.5
    assert model.grade([])[0].shape == (0,)


def test_passages_table(spark):
    df = spark.createDataFrame([*[(*p, "x") for p in PASSAGES], (None, 1, "a", "x"), ("en", None, "a", "x"), ("en", 9, "a", "x"), ("en", 2, None, "x"), ("fr", 2, "bon jour", "x")], "lang string, level int, text string, passage_id string")
    assert fit_passages(df).errors["en"][0] > 0
    assert fit_passages(df.limit(0)) is None


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_held_out_accuracy(spark):
    model = fit_passages(spark.read.parquet("/root/testdata/sf0.001/level_passages.parquet"))
    assert set(model.errors) == {"en", "de", "zh"} and all(e[1] < 0.2 and e[2] > 0.97 for e in model.errors.values())
    passages = read_passages(spark.read.parquet("/root/testdata/sf0.001/level_passages.parquet"))
    unseen, bare = validate(passages), validate(passages, vocabulary=False)
    assert all(e[1] < 0.15 and e[2] > 0.95 for e in unseen.values()) and all(e[1] < 0.5 for e in bare.values())
