"""Registered text queries against their DuckDB equivalents, and against each other's contracts on whole tables."""

import hashlib
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from echograin.llm import queries, shared
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, name):
    assert oracle.assert_equal(QUERIES[name](spark, SF), oracle.connect(SF), SQL[name])


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, docs.values()))
    assert len({r.sequence_id for r in rows}) <= -(-sum(map(len, docs.values())) // 1024) + 1


def test_sentencepiece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_simhash_query_columns(spark):
    rows = QUERIES["op3_simhash"](spark, SF).collect()
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    assert all(r.component_id <= r.doc_id for r in rows)


@pytest.mark.parametrize("name", ["op1_warc", "op6_exact_dedup", "op11_fill_in_middle"])
def test_sql_on_null_and_repeated_ids(spark, tmp_path, name):
    long, ids = "one text " * 20, [1, 1, 2, None, None, 3, 20, 20]
    texts = [long, long, long, long, "only null ids " * 20, "only null ids " * 20, "", None]
    rows = [(i, t) for i in ids for t in texts] + [(None, "no id anywhere " * 20), (None, "no id anywhere " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "http://u", t) for i, t in rows], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = oracle.duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path / table}.parquet/*.parquet'")
    assert oracle.assert_equal(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == len(rows)


def test_queries_in_threads_leave_each_other_alone(spark):
    waits, found = [threading.Barrier(2, timeout=300) for _ in range(2)], {}

    def work(name):
        with shared.Scope(spark):
            df = QUERIES[name](spark, SF)
            waits[0].wait()  # both have written tables, none has read its result
            if name == "op3_simhash":
                QUERIES["op3_simhash"](spark, SF)
            waits[1].wait()
            found[name] = df.count()

    threads = [threading.Thread(target=work, args=(n,)) for n in ("op6_exact_dedup", "op3_simhash")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(found) == {"op6_exact_dedup", "op3_simhash"} and len(set(found.values())) == 1
