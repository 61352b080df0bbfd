"""Pages by elements against their SQL: lengths and blanks at the edges."""

from loam.functions.markup import page_markdown

PAGE = "<html><head><title>t</title><script>var t=\"</p>\";</script></head><body><nav><ul><li>n</li></ul></nav><!-- ad --><div class=\"ad\">x</div><article>{}</article><footer>&copy; f</footer></body></html>"
PAGES = [
    PAGE.format("<h1>t</h1><p>" + "&amp;" * 30 + "</p>"),  # over 120 characters as written, under when decoded
    PAGE.format("<h1>t</h1><p>" + "a" * 114 + "&quot</p>"),
    PAGE.format("<h1> t  &amp;&am</h1><p>one"),
    PAGE.format("<h1>a <b>b</b> c</h1><p>x <b> y </b>z<br>w"),
    PAGE.format("<h1></h1><p>- &nbsp;m</p><p>— </p>"),
    PAGE.format("<p>- m</p><p>a　　b\x0bc d\xa0&nbsp; e</p>"),
    "",
    None,
]


def test_pages_match_sql(spark, tmp_path):
    import duckdb

    from loam.plans.catalog import ORACLE_SQL, QUERIES

    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["html_to_md_elements"](spark, str(tmp_path)).select("page_id", "first", "digest").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["html_to_md_elements"]).fetchall())


def test_texts_stay_in_order():
    assert page_markdown("<h2>a <i>b</i> c</h2><h3>\n<b>d </b></h3>") == "## a b c\n### d"
    assert page_markdown("<main><b>\n x \n y</b></main>" + "z" * 3, (), ("main",)) == "x y\nzzz"
