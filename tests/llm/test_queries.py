"""The subpackage's queries: against their oracles where SQL can say it, else against brute force, on the given small data."""

import pyarrow.parquet as pq
import pytest

from strandbase.llm import oracle, queries
from tests.helpers import oracle_rows, query_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_oracle(spark, name):
    assert query_rows(queries.QUERIES[name](spark, SF)) == oracle_rows(SF, oracle.ORACLE[name])


def test_columns(spark):
    want = {
        "p1_found": "field:string term:string mark:string", "p3_found": "callee:string", "p4_found": "id_a:bigint id_b:bigint", "p5_found": "id_a:bigint id_b:bigint", "p6_found": "group_id:bigint pkg_id:bigint",
        "p7_found": "method_id:bigint from_pos:int to_pos:int", "p8_ids": "doc_id:bigint ids:array<int>", "p9_found": "doc_id:bigint", "p10_found": "doc_id:bigint",
    }
    for name, columns in want.items():
        assert " ".join(f"{n}:{t}" for n, t in queries.QUERIES[name](spark, SF).dtypes) == columns, name


def test_tokens_round_trip_and_agree_with_the_library(spark):
    from tokenizers import Tokenizer

    texts = dict(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, SF).collect()}
    assert got == {k: library.encode(v or "", add_special_tokens=False).ids for k, v in texts.items()}


def test_scores_of_held_out_labels(spark):
    """Texts of the sample, scored by a scorer that hasn't seen them."""
    from strandbase.llm import abuse

    sample = pq.read_table("/root/testdata/sf0.1/abuse_sample.parquet").to_pydict()
    rows = sorted({(t, c) for t, c in zip(sample["text"], sample["category"], strict=True) if t and c})
    scorer = abuse.fit(rows[::2])
    hit = [(scorer.text(t) >= scorer.threshold, c != "none") for t, c in rows[1::2]]
    right = sum(a == b for a, b in hit) / len(hit)
    assert right > 0.9  # some labels are wrong
