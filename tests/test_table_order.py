"""Peaks of equal m/z are added in the order of the table, as the SQL adds them in one thread."""

import itertools

import pytest

from ionflow.plans import catalog, derived

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double"


def _sum(values):
    total = 0.0
    for v in values:
        total += v / 50.0
    return total


def _at_the_floor():
    """Three quantities and one at a quarter of their sum, which stays under the floor in one order of adding alone."""
    for a, b, c in itertools.combinations(range(1, 51), 3):
        if (a + b + c) % 4 == 0:
            for own in itertools.permutations((a, b, c)):
                top = (a + b + c) / 4 / 50.0
                if (top / _sum(own) >= 0.25) != (top / _sum(sorted(own)) >= 0.25):
                    yield own


@pytest.mark.parametrize("files", [1, 3])
def test_strongest_peaks_at_the_floor(spark, tmp_path, files):
    import duckdb

    orders, lines = [], []
    for k, own in enumerate(itertools.islice(_at_the_floor(), 40)):
        key = 11 * 31 * (k + 1) + 1  # an adduct whose mode fits
        orders.append((key, 1, "F", "2-HIGH"))
        # line numbers are in order of quantity, the table is not
        lines += [(key, 1 + sorted(own).index(q), 7, float(q)) for q in own] + [(key, 9, 8, sum(own) / 4)]
    spark.createDataFrame(orders, ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    size = -(-len(lines) // files)
    for n in range(files):
        spark.createDataFrame(lines[n * size : (n + 1) * size], LINES).coalesce(1).write.parquet(f"{tmp_path}/part{n}")
    whole = tmp_path / "lineitem.parquet"
    whole.mkdir()
    for n in range(files):
        next((tmp_path / f"part{n}").glob("*.parquet")).rename(whole / f"{n}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(catalog.oracle_sql()["q_strongest_peaks"]).fetchall())
    assert len(lines) // 4 < len(want) < len(lines) // 2
    assert sorted(map(tuple, catalog.q_strongest_peaks(spark, str(tmp_path)).collect())) == want
    peaks = {r.row_ord: r.ms2_normalized_intensities for r in derived.spectra(spark, str(tmp_path)).collect()}
    assert peaks[orders[0][0]] == [q / 50.0 for k, _, _, q in lines if k == orders[0][0]]
