"""The quality rule's SQL, as it stands, on a table where lines are removed and documents depleted."""

import random

import duckdb

from agree import assert_agree
from ferrule.llm import quality


def test_agrees_with_sql_where_lines_go(spark, tmp_path):
    r = random.Random(11)
    body = lambda n: "\n".join(" ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(9)) for _ in range(n))
    rows = [(i, body(4) + "\nAll rights: reserved 2024\nALL RIGHTS reserved", "a") for i in range(90)]  # fires; twice in a text
    rows += [(200 + i, body(2) + "\nmenu home contact about\n" * 2, None) for i in range(60)]  # a null host; 12 words stay or more
    rows += [(300 + i, body(2) + "\n" + "menu home contact about", "a") for i in range(30)]  # too few documents
    rows += [(400 + i, body(4) + "\nat the limit", "b") for i in range(50)]  # 50 documents are not above 50
    rows += [(500 + i, body(2) + "\n" + "terms and conditions of use", "c") for i in range(51)] + [(501, rows[0][1], "a")]
    copy = body(5)
    rows += [(600 + i, copy, "d") for i in range(80)]  # one text's copies: its lines are no boilerplate
    rows += [(700 + i % 40, body(3) + "\nshared by ten texts of many copies", "e") for i in range(10) for _ in (0,)]
    rows += [r for r in rows[-10:] for _ in range(5)]  # sixty documents, ten texts: fires
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet')")
    got = quality.quality(df)
    assert got.where("words_removed > 0").count() > 150 and got.where("not base_failed and not kept").count() > 0
    kept = {r.doc_id: r for r in got.collect()}
    assert kept[600].words_removed == 0 and kept[600].kept and kept[700].words_removed > 0 and kept[400].words_removed == 0
    assert_agree(got, con, quality.SQL)
