import zlib

import numpy as np
import pytest

from linkloom.llm import quality, toxicity
from linkloom.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, predicted string"


def hold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(spark):
    rows, labels = [], []
    good = "the quick brown fox jumps over lazy dogs while {} rivers flow gently past old stone bridges near {}"
    for i in range(300):
        bad = i % 5 == 1
        toxic = i % 6 == 2
        text = good.format(i * 7, "abcdefghij"[i % 10] * 3 + str(i))
        if bad:
            text = ("BUY!! NOW!! %d!! " % i) * 9
        if toxic:
            text += f" you scoundrel{i % 4} and scoundrel"
        rows.append((i, text, "en", "s", "x", "y"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    edge = [(900, None), (901, ""), (902, " \n "), (903, "word " * 200_000), (None, "a null id"), (0, rows[0][1]), (0, rows[0][1])]
    rows += [(i, t, None, None, None, None) for i, t in edge]
    labels += [(1, 0, 0), (1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module,label,cut", [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_scores(spark, module, label, cut):
    docs, labels = corpus(spark)
    out = module.scored_with_split(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.filter(f"{label} is not null").collect()}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["doc_id"] is not None:
            assert r["held_out"] == hold(r["doc_id"])
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    empty = [r["score"] for r in out if r["doc_id"] in (900, 901, 902)]
    assert len(set(empty)) == 1
    assert module.scored_with_split(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("module,label,keep", [(quality, "quality", quality.keep_good), (toxicity, "toxic", toxicity.drop_toxic)])
def test_filters_keep_columns_and_agree_with_scores(spark, module, label, keep):
    docs, labels = corpus(spark)
    kept = keep(docs, labels)
    assert kept.columns == docs.columns
    scored = module.scored_with_split(docs, labels)
    want = scored.filter("predicted = 1" if label == "quality" else "predicted = 0").count()
    assert kept.count() == want


def test_without_both_classes(spark):
    docs, labels = corpus(spark)
    none = labels.limit(0)
    assert {r["predicted"] for r in quality.scored_with_split(docs, none).collect()} == {1}
    assert {r["predicted"] for r in toxicity.scored_with_split(docs, none).collect()} == {0}


def test_pairs_fit_the_logistic_loss():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(size=(500, 3)) + [1, 0, 0], rng.normal(size=(500, 3))
    w = quality.fit_pairs(better, worse, l2=0.01)

    def loss(v):
        return np.logaddexp(0, -(better - worse) @ v).mean() + 0.005 * v @ v

    for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3:
        assert loss(w + step) >= loss(w)
    assert w[0] > 0.5


def test_folding():
    assert toxicity.fold("ІDІОТ 1d10t! c1own, Ünï​code") == " idiot idiot ldlot ciown clown unicode "
    assert toxicity.fold("2024 was 10%") == " was "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_exceptions_cover_their_matches():
    lexicon = toxicity.Lexicon({"scun": 8.0, "ass": 5.0}, ("scunthorpe", "ass and cart"))
    assert lexicon.density("Scunthorpe is a town") == 0
    assert lexicon.density("an ass and cart") == 0
    assert lexicon.density("an ass and carts") > 0
    assert lexicon.density("scunner in Scunthorpe") > 0
    many = toxicity.Lexicon({"ass": 5.0}, ("ass and cart",))
    assert many.density("ass and cart " * 100) == 0


def test_a_term_may_be_an_exception_as_a_whole_word():
    lexicon = toxicity.Lexicon({"moron": 5.0}, ("moron",))
    assert lexicon.density("a moron") == 0
    assert lexicon.density("some morons") > 0


def test_longer_texts_score_lower():
    lexicon = toxicity.Lexicon({"idiot": 8.0})
    few = [lexicon.density("idiot " + "word " * n) for n in (0, 10, 100, 1000)]
    assert few == sorted(few, reverse=True)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_rows_of_the_tables(spark, module, label):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = module.scored_with_split(docs, labels).filter("held_out").join(labels, "doc_id")
    right = out.filter(f"predicted = {label}").count()
    assert right / out.count() > 0.93


def test_toxic_texts_of_every_language_are_found(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = toxicity.scored_with_split(docs, labels).filter("held_out").join(labels.filter("toxic is not null"), "doc_id")
    by = {}
    for r in out.join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect():
        by.setdefault((r["lang"], r["toxic"]), []).append(r["predicted"])
    for lang in ("en", "de", "fr", "es"):
        assert np.mean(by[lang, 1]) > 0.9, lang
        assert np.mean(by[lang, 0]) < 0.04, lang


def test_few_labels_suffice(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    gone = labels.filter("toxic is not null").join(toxicity.drop_toxic(docs, labels).select("doc_id"), "doc_id", "left_anti")
    english = gone.join(docs.filter("lang = 'en'").select("doc_id"), "doc_id")
    toxic = labels.filter("toxic = 1").join(docs.filter("lang = 'en'").select("doc_id"), "doc_id").count()
    assert toxic > 5 and english.filter("toxic = 1").count() == toxic
    assert gone.filter("toxic = 0").count() == 0
