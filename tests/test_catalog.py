"""Every registered query of the engine, against DuckDB where SQL can express it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexivault.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def flat(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, data, oracle, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    cur = oracle.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(flat(r[i]) for i in at) for r in cur.fetchall())


def test_words_of_whole_texts(spark, data, tmp_path):
    """Every character of a long text is in a word: lines, digits, accented letters and what lies after 400 characters."""
    text = "Élan 12\nnaïve 🙂 œuvre\t" + "word7 " * 1000 + "\nfin"
    spark.read.parquet(f"{data}/documents.parquet").limit(1).selectExpr("* except (text)").withColumn("text", F.lit(text)).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["box_union"](spark, str(tmp_path)).orderBy("page", "word_id").collect()
    assert "".join(r["word_text"] for r in found) == "".join(text.split())
    assert [r["word_text"] for r in found[:5]] == ["Élan", "12", "naïve", "🙂", "œuvre"] and found[-1]["page"] == 3


@pytest.mark.parametrize("name", ["box_union", "char_gap_words"])
def test_characters_are_no_rows(spark, data, name):
    """Texts go whole to the pages' words: no window, and no sort of characters."""
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["hits_with_positions", "rich_hits"])
def test_ties_against_sql(spark, tmp_path, name):
    """More hits of one score than a page holds, in other collections: those of the smallest ids, as in SQL."""
    rows = [(i, "released public license mit license", "en", f"src{30 - i}", 10) for i in range(1, 21)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and len(want) == 10


def test_boxes_in_order(spark, data):
    """ui_boxes gives its rows by document and offset; only the texts are exchanged for it."""
    df = catalog.QUERIES["ui_boxes"](spark, data)
    got = [(r["doc_id"], r["word_offset"]) for r in df.collect()]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert got == sorted(got) and "Window" not in plan and "Generate" not in plan
