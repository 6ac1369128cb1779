"""Every registered corpus query on the smallest tables: columns, rows, and its SQL where it has one."""

import duckdb
import pytest

import corpus_pipeline
from quadrille.llm import queries

D = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id fingerprint component_id",
    "op2": "doc_id n_tokens ids_crc32 parity decoded_sha256 round_trip",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "page_id url text n_chars",
    "op5": "page_id host path rule verdict",
    "op6": "doc_id text n_entities",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id keep_id group_size kept text_sha256",
    "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    own = "pages" if name.split("_")[0] in ("op4", "op5") else "documents"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {own} AS SELECT * FROM read_parquet('{D}/{own}.parquet')")
    n, key = con.execute(f"SELECT count(*) FROM {own}").fetchone()[0], "page_id" if own == "pages" else "doc_id"
    out = queries.QUERIES[name](spark, D)
    rows = out.collect()
    assert out.columns == COLUMNS[name.split("_")[0]].split()
    if name.startswith("op3"):
        assert len({r.doc_id for r in rows}) == n and all(r.length + r.offset <= 2048 for r in rows)
    else:
        assert len(rows) == n == len({r[key] for r in rows})
    if name in queries.ORACLES:
        want = con.execute(queries.ORACLES[name])
        at = [c[0] for c in want.description]
        assert sorted(tuple(r[c] for c in at) for r in rows) == sorted(want.fetchall())


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, D).collect()
    assert rows and all(r.length + r.offset <= 2048 for r in rows)
