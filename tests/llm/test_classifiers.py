import math
import zlib

import numpy as np
import pytest

from fluvia.llm import langid, quality


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def labelled(n=900):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(1, 9))) for _ in range(rng.integers(5, 80)))
    rows, marks = [], []
    for i in range(n):
        text = good()
        if i % 4 == 0:
            text = [text.upper() + "!!", " | ".join(text.split()), " ".join([text.split()[0]] * 40), text.replace(" ", "### ")][i // 4 % 4]
        rows.append((i, text, "x", 0.0))
        marks.append((i, int(i % 4 != 0), 0))
    return rows, marks


def test_quality_on_held_out_rows(spark):
    rows, marks = labelled()
    rows += [(5000, None, "x", 1.0), (5001, "", "x", 1.0), (None, "a b", "x", 1.0), (5, "copy of a row", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([*marks, (1, None, 0), (None, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    truth = {i: q for i, q, _ in marks}
    rated = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rated]) > 0.93
    kept = {r["doc_id"] for r in quality.keep_good(df, labels).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_equals_one_fit_in_memory(spark):
    """The summed normal equations and the binned calibration against ridge and pooling over all rows at once."""
    rows, marks = labelled(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").repartition(3)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(df, labels).collect()}
    x = np.array([quality.statistics(t) for _, t, *_ in rows], np.float32).astype(float)
    y = np.array([q for _, q, _ in marks], float)
    learn = np.array([not held_out(i) for i, *_ in marks])
    model = quality.Model(x[learn].mean(0), np.sqrt(np.maximum(x[learn].var(0), 1e-8)))
    phi = model.lifted(x[learn])
    model.weights = np.linalg.solve(phi.T @ phi / len(phi) + quality.RIDGE * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ y[learn] / len(phi))
    at = np.clip(np.floor((model.raw(x[learn]) + 1) / 3 * quality.BINS), 0, quality.BINS - 1)
    bins = [((k + 0.5) / quality.BINS * 3 - 1, float((at == k).sum()), float(y[learn][at == k].sum())) for k in np.unique(at)]
    model.knots, model.levels = quality.pooled(bins)
    assert np.abs(model.score(x) - np.array([got[i] for i, *_ in rows])).max() < 1e-3


def test_statistics_count_word_pairs_of_every_text():
    assert quality.statistics("a b c d")[9] == 0.75 and quality.statistics("a b a b a b")[9] == 2 / 6


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score_documents(df, none).collect()] == [0.5, 0.5]
    assert quality.score_documents(df.where("false"), none).count() == 0


def test_pooling_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    bins = [(float(x), float(rng.integers(1, 9)), 0.0) for x in range(50)]
    bins = [(x, n, float(rng.integers(0, n + 1))) for x, n, _ in bins]
    x, level = quality.pooled(bins)
    assert (np.diff(level) > 0).all() and (np.diff(x) > 0).all()
    assert quality.pooled([(0, 1, 1.0), (1, 1, 0.0)])[1].tolist() == [0.5]


ALPHABETS = {"aa": "aeiourst", "bb": "oknpyzwr", "cc": "абвгдежи", "dd": "üöäßnlmt"}


def speech(spark, n=800):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lang = list(ALPHABETS)[i % 4]
        rows.append((i, " ".join("".join(rng.choice(list(ALPHABETS[lang]), rng.integers(2, 8))) for _ in range(rng.integers(3, 60))), lang, 0.5))
    rows += [(2000, None, "aa", 1.0), (2001, "123 456 !!", "aa", 1.0), (2002, "", None, 1.0), (2003, "一 丁 丂 七 丄 丅 丆 万 丈 三" * 30, None, 1.0), (None, rows[1][1], None, 1.0), (1, rows[1][1], "bb", 1.0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language_on_held_out_rows(spark):
    rows, df = speech(spark)
    got = langid.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (2000, 2001, 2002))
    assert by_id[None]["lang_pred"] == "bb" and by_id[2003]["rejected"]
    rated = [r for r in got if r["held_out"] and r["doc_id"] < 800]
    assert np.mean([r["lang_pred"] == list(ALPHABETS)[r["doc_id"] % 4] for r in rated]) > 0.98
    assert np.mean([r["rejected"] for r in rated]) < 0.02
    kept = sorted(str(r["doc_id"]) for r in langid.keep_known(df).collect())
    assert kept == sorted(str(r["doc_id"]) for r in got if not r["rejected"])


def test_language_equals_brute_force(spark):
    """Document frequencies and cosines from dictionaries of trigrams, text by text."""
    rows, df = speech(spark, 400)
    model = langid.fit(df)

    def grams(text):
        raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").lower().encode()) + b" "
        out = {}
        for i in range(len(raw) - 2):
            if raw[i : i + 3] != b"   ":
                code = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32 >> 20
                out[code] = out.get(code, 0) + 1
        out.pop(langid._BLANK, None)
        return out

    taught = [grams(t) for i, t, lang, _ in rows if i is not None and not held_out(i) and lang is not None and t and langid.has_letter(t)]
    idf = [math.log((1 + len(taught)) / (1 + sum(d in g for g in taught))) + 1 for d in range(0, langid.DIMENSIONS, 37)]
    assert np.allclose(model.idf[::37], idf, atol=1e-5)
    got = langid.identify(df).collect()
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang_pred"])), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        if i in (1, None) or not langid.has_letter(t):
            continue
        weights = {d: math.log1p(n) * float(model.idf[d]) for d, n in grams(t).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[d]) for d, w in weights.items()) / norm for c in model.centroids]
        assert model.langs[int(np.argmax(cosines))] == r["lang_pred"] and abs(max(cosines) - r["score"]) < 1e-4


def test_language_rejects_foreign_texts_of_any_length(spark):
    _, df = speech(spark)
    model = langid.fit(df)
    rng = np.random.default_rng(9)
    foreign = ["".join(rng.choice(list("一丁丂七丄丅丆万丈三上下"), n)) for n in (6, 12, 40, 400, 70_000)] + ["ΞΕΣΚΕΠΑΖΩ την ψυχοφθόρα βδελυγμία", "привёт щущ"]
    assert [r for *_, r in model.predict(foreign)] == [True] * len(foreign)
    own = ["".join(rng.choice(list("aeiourst"), 6)) + " " + "".join(rng.choice(list("aeiourst"), n)) for n in (5, 6, 7) for _ in range(20)] + ["tres sert " * 30_000]
    assert np.mean([r for *_, r in model.predict(own)]) < 0.05


@pytest.mark.parametrize("clause", ["false", "lang is null"])
def test_language_without_teachers(spark, clause):
    _, df = speech(spark, 8)
    assert {r["lang_pred"] for r in langid.identify(df.where(clause)).collect()} <= {"und"}


def test_clusters_cover_separate_groups():
    rng = np.random.default_rng(4)
    x = langid._normal(np.repeat(np.eye(3, 20), 30, axis=0) + rng.uniform(0, 0.1, (90, 20)))
    c = langid.clustered(x, 3)
    assert ((x @ c.T).max(1) > 0.9).all()


def test_outliers_give_no_centroid():
    rng = np.random.default_rng(5)
    x = langid._normal(np.concatenate([np.repeat(np.eye(2, 20), 100, axis=0) + rng.uniform(0, 0.1, (200, 20)), np.eye(20)[10:13]]))
    c = langid.clustered(x, 4)
    held = np.bincount((x @ c.T).argmax(1))
    assert 2 <= len(c) and held.min() >= langid.LEAST_SHARE * len(x) - 3
