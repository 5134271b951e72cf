"""A query against its SQL run over whole tables: the SQL's own cut of ids, where it has one, is left out of a copy."""

import duckdb

import __spark_entry__ as entry
from tests.test_oracle import FOLDER, TABLES, rows


def whole(spark, name, *cuts, folder=FOLDER):
    """The query's rows and the rows of a copy of its SQL without the cuts."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    sql = entry.oracle_sql()[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, folder)
    return rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())


def write(spark, path, texts):
    """A folder with documents of these texts, numbered from 0."""
    rows = [(i, t, None, "src0", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)
