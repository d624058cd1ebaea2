"""Text counts, robust outlier rules, and the classifier."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodeworks.llm import quality_model, quality_rules
from lodeworks.llm.common import Scratch
from lodeworks.llm.text_stats import with_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string"


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


CASES = [None, "", " ", "one", "a b c d e", "a b c d e a b c d e", "x " * 11, "l\nl\n\n \nl", "Ünï ## $$ 😀 ok", "a\x0bb\x0cc d\x1ce", "a b c d e f a b c d e g a b c d e f", "　wide space", "r " * 4000]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "_words") for i, t in enumerate(CASES)], "doc_id int, text string, _x string")
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in with_counts(docs).collect()}
    assert found == {i: counts(t) for i, t in enumerate(CASES)}


def corpus(seed=3, n=900):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang, source = r.choice(["en", "de"]), r.choice(["big", "big", "big", "a", None])
        w = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(15, 120))]
        if i % 15 == 0:
            w = [x + r.choice(["##", "$$", "%%%"]) for x in w]
        out.append((i, " ".join(w), lang, source))
    return out


def test_rules_reject_the_outliers_and_keep_the_rest(spark):
    rows = corpus() + [(5000, None, None, None), (5001, "", "en", "big")]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(found) == len(rows)
    assert found[5000].base_failed and not found[5000].kept and not found[5001].kept
    assert [i for i, *_ in rows[:900] if found[i].kept == (i % 15 == 0)] == []


def test_rules_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(corpus(4, 300), DOCS)
    take = lambda df: sorted((r.doc_id, r.kept, f"{r.distance or 0:.6g}") for r in quality_rules.judge(df).collect())
    assert take(docs.repartition(1)) == take(docs.repartition(13))


def test_every_group_has_a_verdict_and_empty_tables_no_rows(spark):
    docs = spark.createDataFrame([(i, "some words that are ten or more in number so it passes here", "en", "s") for i in range(5)], DOCS)
    assert all(r.kept and r.distance is not None for r in quality_rules.judge(docs).collect())
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_a_source_of_one_row_is_judged_by_its_language(spark):
    rows = corpus(11, 400)
    sound, loud = rows[1][1], " ".join(w + "##$$%%" for w in rows[1][1].split())
    docs = spark.createDataFrame([*rows, (9001, sound, "en", "lonely\ten"), (9002, loud, "en", "lonely"), (9003, loud, "xx", None), (None, sound, "en", "big")], DOCS)
    found = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert (found[9001], found[9002], found[9003], found[None]) == (True, False, False, True)


def test_kept_rows_are_whole_whatever_their_columns_are_called(spark):
    rows = [(i, t, la, so, i * 2, "w", [1, None], True) for i, t, la, so in corpus(5, 120)]
    names = DOCS + ", n_words int, _text string, x0 array<int>, kept boolean"
    docs = spark.createDataFrame(rows + [(500, "long " * 1 + "word" * 100_000, None, "a", 1, None, None, False)] + rows[:1] * 2, names)
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality_rules.judge(docs).collect() if r.kept}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in map(tuple, docs.collect()) if r[0] in good), key=str)


def exact_estimates(x, lang, group, share=0.75, inner=0.975, steps=60):
    """Concentration steps with subsets of exactly the nearest rows, in numpy; (mean, covariance) by group."""
    p, k = x.shape[1], quality_rules.SHRINK
    names = sorted(set(group))
    at = {g: np.flatnonzero(np.array(group) == g) for g in names}
    floor = np.diag((np.array(quality_rules.FLOOR) * quality_rules.SCALE) ** 2)
    h, q = quality_rules.chi2_quantile(share, p), quality_rules.chi2_quantile(inner, p)
    grow, last = share / quality_rules.chi2_cdf(h, p + 2), inner / quality_rules.chi2_cdf(q, p + 2)

    def moments(sums, factor, above=None):
        n, s, c = sums
        mean = s / n if n else np.zeros(p)
        cov = (c / n - np.outer(mean, mean)) * factor if n else np.zeros((p, p))
        return (mean, cov) if above is None else tuple((n * a + k * b) / (n + k) for a, b in zip((mean, cov), above, strict=True))

    def targets(sums, factor):
        add = lambda own: tuple(sum(x) for x in zip(*own, strict=True))
        top = moments(add(sums.values()), factor)
        return {la: moments(add([sums[g] for g in names if lang[g] == la]), factor, top) for la in set(lang.values())}

    def smooth(sums, factor, langs):
        return {g: (m, c + floor) for g in names for m, c in [moments(sums[g], factor, langs[g])]}

    own = lambda rows: (len(rows), rows.sum(0), rows.T @ rows)
    d2 = lambda e, rows: np.einsum("ij,jk,ik->i", rows - e[0], np.linalg.inv(e[1]), rows - e[0])

    def step(est, langs):
        return smooth({g: own(x[at[g]][np.argsort(d2(est[g], x[at[g]]), kind="stable")[: math.ceil(share * len(at[g]))]]) for g in names}, grow, langs)

    starts = []
    low, mid, high = ({g: np.quantile(x[at[g]], c, axis=0) for g in names} for c in (0.25, 0.5, 0.75))
    robust = {g: (len(at[g]), len(at[g]) * mid[g], len(at[g]) * (np.outer(mid[g], mid[g]) + np.diag(((high[g] - low[g]) / 1.349) ** 2))) for g in names}
    for first in (robust, {g: own(x[at[g]]) for g in names}):
        langs = {g: targets(first, 1.0)[lang[g]] for g in names}
        est = smooth(first, 1.0, langs)
        for _ in range(2):
            est = step(est, langs)
        starts.append({g: (est[g], langs[g]) for g in names})
    best = {g: min((s[g] for s in starts), key=lambda e: np.linalg.slogdet(e[0][1])[1]) for g in names}
    est, langs = {g: best[g][0] for g in names}, {g: best[g][1] for g in names}
    for _ in range(steps):
        est = step(est, langs)
    kept = {g: own(x[at[g]][d2(est[g], x[at[g]]) <= q]) for g in names}
    return smooth(kept, last, {g: targets(kept, last)[lang[g]] for g in names}), d2


def test_estimates_and_verdicts_equal_those_of_exact_steps(spark):
    r = np.random.default_rng(7)
    x, lang, group = [], {}, []
    for g, (la, n) in {"a1": ("a", 400), "a2": ("a", 90), "a3": ("a", 3), "b1": ("b", 250)}.items():
        lang[g] = la
        own = r.normal(size=(n, 5)) @ (r.normal(size=(5, 5)) * 60) + r.normal(size=5) * 300
        own[: n // 6] = r.normal(size=(n // 6, 5)) * 40 + 4000
        x.append(np.round(own))
        group += [g] * n
    x = np.concatenate(x)
    rows = [(lang[g], g, *map(int, v)) for g, v in zip(group, x, strict=True)]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{j} bigint" for j in range(5)))
    with Scratch(spark) as scratch:
        found = {e.source: e for e in quality_rules.fit(df.repartition(5), scratch).collect()}
    want, d2 = exact_estimates(x, lang, group)
    far = quality_rules.chi2_quantile(1 - 1e-7, 5)
    for g, (mean, cov) in want.items():
        e, own = found[g], x[np.array(group) == g]
        w = np.array([[e[f"w{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        ours = ((own - [e[f"m{j}"] for j in range(5)]) @ w.T) ** 2
        assert ((ours.sum(1) > far) == (d2((mean, cov), own) > far)).all()
        assert -2 * np.log(np.diag(w)).sum() == pytest.approx(np.linalg.slogdet(cov)[1], abs=0.3)
    assert sum(int(((x[np.array(group) == g] > 3000).all(1) & (d2(want[g], x[np.array(group) == g]) > far)).sum()) for g in want) >= 120


def test_constant_statistics_reject_nothing(spark):
    docs = spark.createDataFrame([(i, "some words that are ten or more in number so it passes here", "en", "s") for i in range(300)], DOCS)
    assert all(r.kept for r in quality_rules.judge(docs).collect())


def test_chi_square():
    assert quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.975, 5), 5) == pytest.approx(0.975)
    assert quality_rules.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))


def test_estimates_equal_those_of_numpy(spark):
    """Of one group, whose levels are all the same, mean and covariance are the plain ones."""
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, 5)) @ r.normal(size=(5, 5)) * 200).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{j}" for j in range(5)])).selectExpr("'l' AS lang", "cast(null AS string) AS source", *(f"cast(x{j} AS bigint) AS x{j}" for j in range(5)))
    est = quality_rules.estimates(quality_rules.leaning(df.groupBy("lang", "source").agg(*quality_rules._sums()), [], 1.0), [], 1.0).first()
    cov = np.cov(x.T, bias=True) + np.diag((np.array(quality_rules.FLOOR) * quality_rules.SCALE) ** 2)
    assert [est[f"m{j}"] for j in range(5)] == pytest.approx(x.mean(0).tolist())
    assert est.logdet == pytest.approx(float(np.linalg.slogdet(cov)[1]))
    w = np.linalg.inv(np.linalg.cholesky(cov))
    assert [est[f"w{i}_{j}"] for i in range(5) for j in range(i + 1)] == pytest.approx([w[i, j] for i in range(5) for j in range(i + 1)])


def test_classifier_on_held_out_rows(spark):
    rows = [(i, t) for i, t, *_ in corpus(9)]
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(i, int(i % 15 != 0)) for i, _ in rows], "doc_id bigint, quality int")
    model = quality_model.fit(docs, labels)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    found = [(r.doc_id, r.score) for r in model.score(docs).collect() if r.doc_id in held]
    assert len(found) == len(held) > 200
    assert sum((s >= 0.5) == (i % 15 != 0) for i, s in found) >= 0.98 * len(found)


def test_held_out_labels_change_nothing(spark):
    rows = [(i, t) for i, t, *_ in corpus(9, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    a = quality_model.fit(docs, spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows], "doc_id bigint, quality int"))
    b = quality_model.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0) if held(i) else int(i % 5 != 0)) for i, _ in rows], "doc_id bigint, quality int"))
    assert a.dumps() == b.dumps()


def test_models_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = quality_model.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert [r.score for r in none.score(docs).collect()] == [0.5, 0.5]
    learnt = next(i for i in (1, 2) if zlib.crc32(str(i).encode()) % 3 != 1)
    one = quality_model.fit(docs, spark.createDataFrame([(learnt, 1), (3 - learnt, None)], "doc_id bigint, quality int"))
    assert all(r.score > 0.999 for r in one.score(docs).collect())
    again = quality_model.QualityModel.loads(one.dumps())
    assert [r.score for r in again.score(docs).collect()] == [r.score for r in one.score(docs).collect()]
    assert none.score(docs.limit(0)).count() == 0


def test_scores_equal_those_of_an_independent_discriminant(spark):
    """Log density differences by inverse and determinant, from statistics that are counted anew."""
    rows = [(i, t) for i, t, *_ in corpus(9, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    label = {i: int(i % 4 != 0) for i, _ in rows}
    labels = spark.createDataFrame(list(label.items()), "doc_id bigint, quality int")
    model = quality_model.fit(docs, labels)
    assert model.dumps() == quality_model.fit(docs.repartition(1), labels.repartition(3)).dumps()

    def stats(t):
        n, chars, symbols, dup, _ = counts(t)
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        upper, marks, other = sum(c.isupper() for c in t), t.count("!") + t.count("?"), sum(not (c.isalnum() or c.isspace()) for c in t)
        rate = lambda x, of: math.log(1 + 10 * x / of)
        return [math.log((chars + 100) / (n + 20)), rate(symbols, n + 20), rate(upper, chars + 100), rate(marks, n + 20), rate(other, chars + 100), math.log(len(set(words)) + 10) - 0.88 * math.log(n + 10), math.log(n + 10), rate(dup, len(lines) + 4)]

    x = {i: np.array(stats(t)) for i, t in rows}
    own = {k: np.array([x[i] for i, y in label.items() if y == k and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)}
    total = sum(map(len, own.values()))
    cov = {k: np.cov(v.T, bias=True) for k, v in own.items()}
    pooled = sum(len(own[k]) * cov[k] for k in own) / total

    def log_density(k, v):
        c, d = 0.8 * cov[k] + 0.2 * pooled + 1e-3 * np.eye(8), v - own[k].mean(0)
        return math.log(len(own[k]) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.inv(c) @ d

    for r in model.score(docs).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(min(700, log_density(0, x[r.doc_id]) - log_density(1, x[r.doc_id])))), abs=2e-3)


def test_scoring_leaves_other_columns_alone(spark):
    rows = [(1, "a b c", 7, "mine", 2.5, [1]), (None, None, None, None, None, None), (1, "a b c", 7, "mine", 2.5, [1]), (2, "w " * 50_000, 0, "", 0.0, [])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, _words string, _x0 double, row array<int>")
    model = quality_model.fit(docs, spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id bigint, quality int"))
    out = model.score(docs, score_col="s")
    assert out.columns == [*docs.columns, "s"]
    assert sorted((tuple(r)[:-1] for r in out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
