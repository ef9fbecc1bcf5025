"""Every query of the library against its SQL oracle."""

import decimal

import duckdb
import pytest

from strataline import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, decimal.Decimal) and x == int(x):
        return str(int(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_oracle(spark, con, small, name):
    df = catalogue.queries()[name](spark, small)
    found = con.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_validators_find_the_planted_faults(spark, small):
    for name in ("validate_strict", "mapping_bijection", "event_integrity"):
        assert not catalogue.queries()[name](spark, small).isEmpty()


def test_composed_plan_fetches_every_bin_once_and_covers_whole_runs(spark):
    d, cfg = "/root/testdata/sf0.01", catalogue.planner.PlanConfig(seed=3)
    packed = {s: catalogue.runs.packed(catalogue.runs.ranked(r(spark, d)), 4) for s, r in (("source", catalogue.newer), ("target", catalogue.older))}
    plan = catalogue.planner.merge_plan(3, packed["source"], 4, packed["target"], 4, cfg)
    z, bins = catalogue.planner.bin_capacity(cfg), {}
    for side, table in (("source", plan.source_bins), ("target", plan.target_bins)):
        keys = sorted(r["key"] for r in packed[side].select("key").collect())
        blocks = -(-len(keys) // 4)
        assert catalogue.planner.plan_violations(table, blocks, z).isEmpty()
        of_block = [r["bin_index"] for r in sorted(table.collect()) for _ in range(r["real_count"])]
        assert len(of_block) == blocks
        bins[side] = {r["bin_index"]: [] for r in table.collect()}
        for i, k in enumerate(keys):
            bins[side][of_block[i // 4]].append(k)
    rows = sorted(plan.points.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows))) and {(r["side"], r["bin_index"]) for r in rows} == {(s, b) for s, x in bins.items() for b in x}
    assert all((not bins[r["side"]][r["bin_index"]]) if r["is_dummy"] else bins[r["side"]][r["bin_index"]][r["record_index"]] == r["key"] for r in rows)
    order = [(r["is_dummy"], r["key"] or 0, r["signed_tag"]) for r in rows]
    assert order == sorted(order)
    want, nth = [("source", 0), ("target", 0)], {"source": 0, "target": 0}
    for r in rows:
        nth[r["side"]] += 1
        if nth[r["side"]] < len(bins[r["side"]]):
            want.append((r["side"], nth[r["side"]]))
    assert [(r["side"], r["bin_index"]) for r in sorted(plan.fetches.collect(), key=lambda r: r["fetch_no"])] == want
    assert catalogue.planner.fetch_violations(plan.fetches, plan.points).isEmpty()
    with pytest.raises(catalogue.merge.MergeIdentity):
        catalogue.planner.merge_plan(4, packed["source"], 4, packed["target"], 4, cfg)


def test_segments_of_all_events_are_those_of_the_builder(spark, small):
    keys = sorted(r["key"] for r in catalogue._event_keys(spark, small).collect())
    want = [(i, s.start_rank, s.end_rank) for i, s in enumerate(catalogue.pgm.build(keys, catalogue.EPSILON).segments)]
    assert sorted(map(tuple, catalogue.queries()["pgm_segments_events"](spark, small).collect())) == want


@pytest.fixture(scope="module")
def again(small, tmp_path_factory):
    """Events four times, every third of them once, so that times are repeated; other user and event ids."""
    d = tmp_path_factory.mktemp("again")
    duckdb.sql(f"COPY (SELECT event_id + 1000 * i AS event_id, ts, user_id + 15 * i AS user_id, event_type, value, props FROM '{small}/events.parquet', range(4) t(i) WHERE i = 0 OR event_id % 3 > 0) TO '{d}/events.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["pgm_search_contract", "pgm_certificate_band"])
def test_query_equals_oracle_on_repeated_times(spark, again, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{again}/events.parquet'")
    df, found = catalogue.queries()[name](spark, again), con.sql(catalogue.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry_needs_no_corpus_operators():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
