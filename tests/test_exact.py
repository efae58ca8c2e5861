"""Queries against their SQL on small tables whose rows lie where results have differed."""

import duckdb

import bazaarline.registry as registry


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over the given tables."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, df in tables.items():
        path = f"{folder}/{table}.parquet"
        df.coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key), sorted(want.fetchall(), key=key)


def test_border_colour_where_a_share_is_met_exactly(spark, tmp_path):
    """100 * 1.15 is 115, and no less as it is in doubles."""
    means = [(r, g, b) for share in (92, 150, 140, 125, 120, 115, 75) for x in range(20, 251, 5) for y in [x * share // 100] if y < 255 for r, g, b in ((x, y, 20), (y, x, 20), (20, x, y), (20, y, x), (x, 20, y), (y, 20, x))]
    rows = [(k, [(c + 0.5) / 127 - 1 for c in mean]) for k, mean in enumerate(means)]
    got, want = both(spark, tmp_path, "dm_15_border_colour", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == want and len({c for _, c in got}) > 5


def test_pages_of_one_address_that_give_items_in_both_ways(spark, tmp_path):
    """One address with a page that carries items and one that has links only."""
    rows = [(k, "http://a/x" if k < 4 else f"http://a/{k}", f'<a href="/{k}">one</a><a href="/y">two</a>') for k in range(9)]
    got, want = both(spark, tmp_path, "sc_01_page_links", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got == want and {r[1] for r in got if r[0] == "http://a/x"} == {"json", "tags"}


def test_addresses_of_an_item_are_told_apart_before_they_are_written_out(spark, tmp_path):
    """Repeated addresses, one that is another kind's number, and ones that aren't known."""
    from datetime import datetime

    day = datetime(2001, 3, 4, 5, 6)
    rows = [(1, 7, 1, 7, day), (1, 7, 2, 7, day), (1, 8, 1, 7, None), (1, 9, 1, None, day), (2, 9, 2, None, None), (2, 9, 3, 9, day)]
    lineitem = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_shipdate timestamp_ntz")
    got, want = both(spark, tmp_path, "so_16_source_urls", lineitem=lineitem)
    assert got == want and (1, "s", 2) in got
    plan = registry.QUERIES["so_16_source_urls"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
