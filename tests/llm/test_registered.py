"""The registered queries on the smallest tables, where these are present: columns, rows, SQL."""

from pathlib import Path

import pytest
from pyarrow import parquet

import __spark_entry__ as contract

TABLES = Path("/root/testdata/sf0.001")
COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2": "doc_id start n_tokens ids_crc32",
    "op3": "doc_id held_out score predicted",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5": "doc_id held_out lang_pred score",
    "op6": "doc_id n_runs n_words_removed",
    "op7": "doc_id item_id distance",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id fingerprint component_id",
    "op10": "doc_id size text_crc32 law shard slot grown_shard",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op12": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op13": "vec_id code error label_error codebooks_sha256",
}
KEYS = {"op13": ("embeddings", "vec_id")}
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")


def test_every_operator_is_registered():
    named = {n.split("_")[0] for n in contract.queries()}
    assert set(COLUMNS) <= named and "pipeline" in contract.queries()


@pytest.mark.parametrize("op", [*COLUMNS])
def test_columns_and_rows(spark, op):
    duckdb = pytest.importorskip("duckdb")
    name = next(n for n in contract.queries() if n.startswith(op + "_"))
    found = contract.queries()[name](spark, str(TABLES))
    assert set(COLUMNS[op].split()) <= set(found.columns)
    rows = found.toPandas()
    name_of, key = KEYS.get(op, ("documents", "doc_id"))
    there = parquet.read_metadata(f"{TABLES}/{name_of}.parquet").num_rows
    # matches, changed documents and pieces are not as many as documents
    assert len(rows) == there or op in ("op6", "op7", "op8") and len(rows)
    if name in contract.oracle_sql():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{TABLES}/{name_of}.parquet'")
        theirs = con.execute(contract.oracle_sql()[name]).df().sort_values(key, ignore_index=True)
        mine = rows.sort_values(key, ignore_index=True)[list(theirs.columns)]
        assert mine.astype(str).equals(theirs.astype(str))
