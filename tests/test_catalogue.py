"""Every engine query against its oracle SQL."""

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spindrift.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    if name in SQL:
        oracle.compare(spark, sf_dir, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_skew_join_counts_all_customers(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert sum(r.n for r in QUERIES["join_dup_skew_whole"](spark, sf_dir).collect()) == n * n


def _events(folder, props):
    folder.mkdir()
    pq.write_table(pa.table({"event_id": pa.array(range(len(props)), pa.int64()), "props": pa.array(props, pa.string())}), folder / "events.parquet")
    return str(folder)


def test_failure_budget_admits_the_planted_failures_and_no_other(spark, tmp_path):
    # 200 leaves of 20 records: three of four hold a 13, and one record has no props, one no k
    props = ['{"k": 13}' if i % 20 == 7 and i // 20 % 4 else f'{{"k": {i % 11}}}' for i in range(4000)]
    props[1], props[2] = None, "{}"
    oracle.compare(spark, _events(tmp_path / "planted", props), QUERIES["failure_budget"], SQL["failure_budget"])
    oracle.compare(spark, _events(tmp_path / "all", ['{"k": 13}'] * 40), QUERIES["failure_budget"], SQL["failure_budget"])
    props[3] = "no json"
    with pytest.raises(RuntimeError, match="151 chunks failed, 150 may"):
        QUERIES["failure_budget"](spark, _events(tmp_path / "broken", props))
