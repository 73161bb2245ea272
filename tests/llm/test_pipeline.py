import hashlib

import pytest

import corpus_pipeline
from linkloom.llm import minhash, mixing, pieces, quality, toxicity
from linkloom.llm.common import saved, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    out, docs = [], table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
        out.append(docs)
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(spark, results):
    want = table(spark, SF, "documents").columns
    assert all(df.columns == want for df in results[:-1])


def test_every_stage_takes_effect(spark, results):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert ids(results[0]) == ids(quality.scored_with_split(docs, labels).filter("predicted = 1"))
    assert ids(results[1]) == ids(toxicity.scored_with_split(results[0], labels).filter("predicted = 0"))
    assert ids(results[2]) == ids(minhash.near_duplicates(results[1]).filter("kept"))
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(results[2], mixing.five_two_one).collect()}
    assert ids(results[3]) == sorted(i for i, n in taken.items() for _ in range(n))
    coder = pieces.Coder(pieces.load(corpus_pipeline.public_model()))
    want = sorted((r["doc_id"], len(coder.encode(r["text"])) // 4) for r in results[3].collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in results[4].collect()) == want


def test_token_ids_are_written(spark, results):
    coder = pieces.Coder(pieces.load(corpus_pipeline.public_model()))
    got = results[4].collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == sorted((r["doc_id"], coder.encode(r["text"])) for r in results[3].collect())
    assert all(r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_run(spark, results):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, results[-1].collect()))


def test_labelled_clean_documents_stay(spark, results):
    labels = table(spark, SF, "labels")
    clean = labels.filter("quality = 1 and toxic = 0").join(table(spark, SF, "documents"), "doc_id")
    assert results[1].join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.95 * clean.count()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edge_documents(spark):
    rows = [(i, f"plain words of document {i} that {i * 7} others hold " * 4, "en", f"s{i % 3}", 9) for i in range(40)]
    rows += [(None, "a row without an id, but with words of its own", None, None, None), (100, None, None, None, None), (101, "", "", "", 0)]
    rows += [(102, " \n", "x", "s1", 2), (103, "long " * 300_000, "en", "s1", 9), rows[3], rows[3], (104, rows[5][1], "en", "s2", 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("place", range(5))
def test_stages_bear_nulls_repeats_and_long_texts(spark, place):
    docs = edge_documents(spark)
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, docs, SF).collect()
    ids_in, ids_out = [r["doc_id"] for r in docs.collect()], [r["doc_id"] for r in out]
    assert set(ids_out) <= set(ids_in)
    if name == "toxicity":
        assert {None, 100, 101, 102, 103} <= set(ids_out)
    if name == "near copies":
        assert {None, 100, 101, 102, 103} <= set(ids_out) and ids_out.count(3) == 1 and 5 in ids_out and 104 not in ids_out
    if name == "encoding":
        assert sorted(map(str, ids_out)) == sorted(map(str, ids_in)) and {r["n_tokens"] for r in out if r["doc_id"] in (100, 101)} == {2}
    if name != "encoding":
        assert stage(spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("place", range(5))
def test_stages_bear_empty_tables(spark, place):
    docs = edge_documents(spark).limit(0)
    assert corpus_pipeline.STAGES[place][1](spark, docs, SF).count() == 0
