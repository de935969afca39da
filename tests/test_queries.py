from __future__ import annotations

import oracle
import pytest

from tickloom import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    """Matches its SQL; a query without SQL runs."""
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in SQL:
        assert not oracle.differences(got, oracle.database(sf_dir).execute(SQL[name]).df())
    else:
        assert len(got)


def test_self_excitation_fits_every_week(spark, sf_dir):
    from tickloom.plans import adapters

    t = adapters.tape(adapters.events(spark, sf_dir)).select("symbol", "ts_us").toPandas()
    size = t.groupby([t["symbol"] % 5, t["ts_us"] // (7 * 86_400_000_000)]).size()
    want = {k for k, n in size.items() if n >= 50}
    got = catalog.queries()["e9_self_excitation"](spark, sf_dir).toPandas()
    assert len({w % 4 for _, w in want}) > 1
    assert set(zip(got["pool"], got["week"], strict=True)) == want


def test_round_trip_of_many_symbols_and_low_prices(spark, tmp_path):
    """Symbols past the 65,536 locate codes of a feed, and prices below zero."""
    name = "s2_round_trip"
    own = "select id as event_id, timestamp '2024-01-01' + to_seconds(id) as ts, case when id < 1100 then 3 else 65000 + id end as user_id, case when id < 1100 or id % 2 = 0 then 'view' else 'purchase' end as event_type, cast(id % 97 as double) as value, '{}' as props from range(2000) t(id)"
    con = oracle.database(str(tmp_path))
    con.execute(f"copy ({own}) to '{tmp_path}/events.parquet' (format parquet)")
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    assert not oracle.differences(got, oracle.database(str(tmp_path)).execute(SQL[name]).df())
