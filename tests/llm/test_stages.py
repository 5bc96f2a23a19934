"""Every stage of the pipeline on nulls, empty and long texts, repeats, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from mailwarden.llm.common import table

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)
#: Names that the stages use themselves.
CLASHES = ("score", "class_id", "class_size", "n_items", "keep", "taken", "size", "rank", "n", "key", "hash", "line", "predicted", "contaminated", "items", "target", "label", "quality", "node", "component", "a", "b")


@pytest.fixture(scope="module")
def docs(spark):
    plain = table(spark, SF, "documents")
    passage = " ".join(table(spark, SF, "benchmark").where("length(text) > 200").orderBy("item_id").first().text.split())
    line = "a line that stands in twelve documents"
    rows = [
        (900001, None, "en", "x", None), (900002, "", None, None, 0), (900003, "same words here again and again", None, "x", 3), (900003, "same words here again and again", None, "x", 3),
        (None, "a text without an id at all, but some words", None, None, None), (900004, "word " * 50_000, "en", "x", None), (900005, "\n\n \n", "en", "x", 4), (900006, passage, "en", "x", None),
        *((900100 + k, f"{line}\nown words of document {k} {'abcdefghijkl'[k] * 9}", "en", "x", None) for k in range(12))]
    both = plain.unionByName(spark.createDataFrame(rows, plain.schema))
    return both.withColumns({c: F.lit("c") for c in CLASHES})


def odd(out):
    """doc_ids of the rows added to the table, in order; null first."""
    return sorted((r.doc_id for r in out.select("doc_id").collect() if r.doc_id is None or r.doc_id > 900_000), key=lambda i: (i is not None, i))


@pytest.mark.parametrize("name", list(STAGES))
def test_stage(spark, docs, name):
    out = STAGES[name](spark, docs, SF).cache()
    copies = [900100 + k for k in range(12)]
    every = [None, 900001, 900002, 900003, 900003, 900004, 900005, 900006, *copies]
    got = odd(out)
    if name == "quality classifier":
        assert out.columns == docs.columns and set(got) <= set(every)
    elif name == "line dedup":
        assert out.columns == docs.columns and got == every
        texts = {r.doc_id: r for r in out.where("doc_id > 900000").collect()}
        assert [k for k in copies if "twelve" in texts[k].text] == [900100]  # the first keeps it
        assert all(texts[k].text == f"own words of document {k - 900100} {'abcdefghijkl'[k - 900100] * 9}" for k in copies[1:])
        assert texts[900101].n_chars == len(texts[900101].text) and texts[900001].n_chars == 0
    elif name == "near-dedup":
        assert out.columns == docs.columns
        assert got == [i for k, i in enumerate(every) if k != 4 and i != 900002] or got == [i for k, i in enumerate(every) if k != 4]
    elif name == "decontamination":
        assert out.columns == docs.columns and got == [i for i in every if i != 900006]
    else:
        assert set(out.columns) == {*docs.columns, "words_taken", "words_target"}
        assert not {900001, 900002, 900005} & set(got) and 900004 in got
        assert out.where("words_taken <= 0").count() == 0
    assert out.where("score != 'c' OR class_id != 'c' OR target != 'c'").count() == 0
    out.unpersist()


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_without_rows(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0
