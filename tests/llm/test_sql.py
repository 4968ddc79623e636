"""The SQL of the near-duplicate queries against the queries, on tables that hold links and odd rows."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from veilspark.llm import queries


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 16))
    rows = [(base[k % 6] + 0.03 * k * rng.normal(size=16)).astype(np.float32).tolist() for k in range(40)]
    rows += [rows[0], rows[1], [0.0] * 16, None, [], [None, *rows[0][1:]], [float("nan"), *rows[0][1:]]]
    return pa.table({"vec_id": pa.array(range(100, 100 + len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})


def texts():
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(4):
        base = [f"w{k}" for k in rng.integers(0, 500, 120)]
        for swaps in range(6):  # similarities from 1 down to below 0.85
            words = list(base)
            for at in rng.choice(120, swaps, replace=False):
                words[at] = "changed"
            rows.append(" ".join(words))
    rows += [rows[0].upper(), "one two", "One\ttwo\n", "", None, " \n", "a b c d e"]
    return pa.table({"doc_id": pa.array(range(7, 7 + len(rows)), pa.int64()), "text": pa.array(rows)})


@pytest.mark.parametrize("name, table, make", [("op2_embedding_neardup", "embeddings", vectors), ("op8_minhash_neardup", "documents", texts)])
def test_sql_equals_query(spark, tmp_path, name, table, make):
    pq.write_table(make(), tmp_path / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = sorted(con.execute(queries.SQL[name]).fetchall())
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == want
    assert any(row[-2] != row[0] for row in want)
