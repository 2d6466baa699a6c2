"""The registered queries over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import verify
from eddyline.llm import queries, tokens

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    verify.register(c, DATA)
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, con, name):
    mine = queries.QUERIES[name](spark, DATA).toPandas()
    assert verify.compare(mine, con.sql(queries.ORACLES[name]).df()) == ""


def test_percentiles(spark, con):
    found = queries.p3_percentiles(spark, DATA).toPandas()
    n = con.sql("""select count(*) from (select *, row_number() over (partition by nullif(lower(trim(order_id)), '') order by msg_offset) as rn from order_messages)
        where (rn = 1 or nullif(lower(trim(order_id)), '') is null) and order_time is not null and amount is not null and not isnan(amount)""").fetchall()[0][0]
    whole = found[found["order_day"].isna()]
    assert whole["n"].sum() == n == found["n"].sum() - n
    assert (found["p50"] <= found["p90"]).all() and (found["p95"] <= found["p99"]).all()


def test_containers_hold_every_text_once(spark, con):
    rows = queries.p8_containers(spark, DATA).collect()
    seen: dict[int, int] = {}
    for r in rows:
        assert r["n_tokens"] <= queries.CAPACITY
        for c in r["contents"]:
            seen[c["item_id"]] = seen.get(c["item_id"], 0) + c["length"]
    coder = tokens.encoder(tokens.DEFAULT_VOCABULARY)
    want = {i: len(coder.encode_ordinary(t)) for i, t in con.sql("select doc_id, text from documents where text <> ''").fetchall()}
    assert seen == want and len(rows) <= 1.05 * sum(want.values()) / queries.CAPACITY + 1


def test_mix_keeps_caps(spark, con):
    caps = dict(con.sql("select source, max_repeats from mix_targets").fetchall())
    rows = queries.p9_mix(spark, DATA).collect()
    assert rows and all(1 <= r["repeats"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    shares = {r["source"]: r for r in queries.p9_shares(spark, DATA).collect()}
    assert set(shares) == set(caps)
    for source, r in shares.items():
        assert r["tokens"] == sum(x["n_tokens"] * x["repeats"] for x in rows if x["source"] == source)
        assert abs(r["tokens"] - r["budget"]) <= max([x["n_tokens"] for x in rows if x["source"] == source], default=0)


def test_empty_tables(spark, empty_tables):
    found = {name: query(spark, empty_tables).count() for name, query in queries.QUERIES.items()}
    assert {name: n for name, n in found.items() if n} == {"p8_checks": 1}


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES) - {"p8_checks"}))  # many texts of one length leave more space than it allows
def test_skewed_tables(spark, skewed_tables, name):
    c = duckdb.connect()
    verify.register(c, skewed_tables)
    assert verify.compare(queries.QUERIES[name](spark, skewed_tables).toPandas(), c.sql(queries.ORACLES[name]).df()) == ""
