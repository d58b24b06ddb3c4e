"""The registered queries: against their SQL where they have one, else against plain Python, on the smallest tables."""

import os
import zlib

import brute
import duckdb
import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in sql.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


def test_op7(spark, sql):
    rows = sql.execute("select doc_id, text from documents").fetchall()
    assert {r[0]: tuple(r[1:]) for r in queries.op7_suffix_dedup(spark, SF).collect()} == brute.repeated_strings(rows)


def test_op2(spark, sql):
    """Every planted token and nothing else is a secret."""
    n = sql.execute("select sum(len(regexp_extract_all(text, '(?i)token = \"[0-9a-f]{40}\"'))) from documents").fetchall()[0][0]
    got = queries.op2_secret_scan(spark, SF).where("is_secret").collect()
    assert len(got) == n and all(r["n_chars"] == 40 for r in got)


def test_op4(spark, sql):
    got = queries.op4_source_mixing(spark, SF)
    assert got.count() == sql.execute("select count(*) from documents").fetchall()[0][0]
    assert got.where("selected and probability = 0").count() == 0


def test_op6(spark):
    got = queries.op6_ordinal_quality(spark, SF).join(queries.grades(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id")
    assert got.where("grade = 0 and kept").count() <= 0.2 * max(1, got.where("grade = 0").count())


def test_op10(spark):
    got = queries.op10_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
