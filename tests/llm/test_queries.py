"""Every opN_ query runs over a whole table, and agrees with its SQL in DuckDB, or with the operator's plain definition."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
import pytest

from vispark.llm.chat_format import with_neighbours_answers
from vispark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def _rows(df):
    plain = lambda v: "-" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLE_SQL:
        n = spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert len(got) == n or name == "op5_packing" and len(got) >= n
        return
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_token_queries_against_the_library(spark):
    from tokenizers import Tokenizer

    from vispark.llm.tokens import default_vocabulary

    library = Tokenizer.from_file(default_vocabulary())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    files = {r.doc_id: r for r in QUERIES["op1_binary_output"](spark, DATA).collect()}
    pieces: dict[int, list] = {}
    for r in QUERIES["op5_packing"](spark, DATA).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    at = 0
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        raw = lambda x: struct.pack(f"<{len(x)}I", *x)
        r = files[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw([*ids, 0])))
        at += r.n_tokens
        whole = [*ids, 2]
        for p in pieces[d.doc_id]:
            assert p.ids_crc32 == zlib.crc32(raw(whole[p.start : p.start + p.length])) and p.length <= 1024
        assert sum(p.length for p in pieces[d.doc_id]) == len(whole)


def test_pairs_from_neighbours(spark):
    rows = [
        (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (2, 1, "assistant", "x"), (2, 3, "assistant", "a2"), (4, 0, "assistant", None),
        (None, 0, "assistant", "n"), (5, 0, "user", "q5"), (1, 0, "user", "q1"), (5, None, None, "t"),
    ]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chosen, rejected = with_neighbours_answers(c)
    key = lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else v for v in r)
    assert sorted(chosen.collect(), key=key) == sorted([(i, t, r or "", x or "") for i, t, r, x in rows], key=key)
    want = [(i, t, r or "", x or "") for i, t, r, x in rows if (i, t, x) not in ((1, 1, "a1"), (2, 3, "a2"), (4, 0, None))] + [(1, 1, "assistant", "a2")]
    assert sorted(rejected.collect(), key=key) == sorted(want, key=key)
