"""Every pipeline stage on empty tables, nulls, repeated rows and clashing names."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty(spark, empty, name):
    out = STAGES[name](spark, empty, SF)
    assert out.columns == empty.columns and out.count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, name):
    text = "some words of a text that is long enough to pass the rules of the first stage " * 1 + " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "src0", len(text)), (1, text, "en", "src0", len(text)), (None, text, None, None, None), (2, None, "en", "src0", None), (3, "", None, "src1", 0), (4, "x" * 200_000, "fr", "src2", 200_000), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = df.selectExpr("*", "1 AS node", "2 AS kept_id", "3 AS named_id", "4 AS r_lang", "5 AS topic", "6 AS words", "7 AS item_id", "8 AS cl")
    out = STAGES[name](spark, clash, SF)
    assert out.columns == clash.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert set(got) <= {(r[0], r[1]) for r in rows}
    if name == "near dedup":
        assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 4]
    if name in ("decontamination", "secret scan"):
        assert len(got) == len(rows)
    if name == "quality rules":
        assert got.count((1, text)) == 2 and (3, "") not in got
