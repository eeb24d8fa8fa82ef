from tessera.llm import urls

CASES = [
    (1, "HTTP://Www.Example.ORG/es/x?q=1", "www.example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    (3, "http://example.org/en/27#/en/1", "example.org", "/en/27", "org/", "allow"),
    (4, "https://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
    (5, "https://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    (6, "https://notexample.org?x", "notexample.org", "", None, "allow"),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "http://casino.net/a.html", "casino.net", "/a.html", None, "block"),
    (10, "x://www.casino.net/a/?u=http://b.org/", "www.casino.net", "/a/", None, "block"),
    (11, "http://other.net/a", "other.net", "/a", None, "allow"),
    (12, "", "", "", None, "allow"),
    (13, "http://sub.example.org/es/", "sub.example.org", "/es/", "example.org/es/", "block"),
    (14, "://", "", "", None, "allow"),
    (15, "http://KÄSE.com/DE/", "kÄse.com", "/DE/", None, "allow"),
    (9, "http://casino.net/a.html", "casino.net", "/a.html", None, "block"),
]


def pages(spark, rows=CASES):
    return spark.createDataFrame([(i, u) for i, u, *_ in rows], "page_id long, url string")


def test_cases(spark):
    p = pages(spark)
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judged(p, urls.word_list(p)).collect())
    assert got == sorted((i, h, q, r or "", v) for i, _, h, q, r, v in CASES)


def test_filter_never_loses_a_listed_url(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.net/p') as canon")
    asked = spark.range(6000).selectExpr("id", "concat('h', id, '.net/p') as canon", "1 as block", "2 as word0")
    out = urls.block_listed(asked, listed)
    assert out.where("is_listed").count() == 3000
    assert out.where("is_listed and id >= 3000").count() == 0
    assert out.columns == ["id", "canon", "block", "word0", "is_listed"]


def test_filter_passes_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('h', id) as canon")
    n = 188
    bloom = urls.bloom_filter(listed, n)
    other = urls.with_bits(spark.range(3000, 9000).selectExpr("concat('h', id) as canon"), "canon", n).join(bloom, "block")
    assert other.where(" and ".join(f"word{i} & bit{i} = bit{i}" for i in range(8))).count() < 120


def test_empty_tables(spark):
    p = pages(spark, [])
    assert urls.judged(p, urls.word_list(p)).count() == 0
    assert urls.judged(pages(spark), urls.word_list(p)).where("is_listed").count() == 0


def test_very_long_urls_and_hosts(spark):
    rows = [(1, "http://" + "a" * 100_000 + ".org/x"), (2, "http://h.com/fr/" + "p/" * 200_000), (3, "x" * 300_000), (4, "://" + "?" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (len(r.host), len(r.path), r.rule, r.verdict) for r in urls.judged(pages, urls.word_list(pages)).collect()}
    assert got == {1: (100_004, 2, "org/", "allow"), 2: (5, 400_004, "com/fr/", "allow"), 3: (0, 0, None, "allow"), 4: (0, 0, None, "allow")}


def test_noisy_pages_list_their_url(spark, tmp_path):
    """A page is blocked for another page's html under the same canonical URL; pages are read once."""
    noise = "word%%% more### " * 10
    rows = [
        (1, "http://a.net/p?x=1", f"<p>{noise}</p>"), (2, "https://www.a.net/p.html#t", "<p>clean</p>"), (3, "http://a.net/q", noise[: len(noise) // 2]), (4, "http://b.net/fr/1", None),
        (5, None, noise), (6, "http://c.org/x", noise), (7, "http://c.com/de/1", ""), (8, "http://A.net/p/", "###%%%"), (8, "http://A.net/p/", "###%%%"), (None, "http://d.net", "***$$$" * 50_000),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as canon", "1 as block", "'y' as host")
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    out = urls.op3_url_filter(spark, str(tmp_path))
    assert not any("pages.parquet" in f for f in out.inputFiles())
    got = sorted((r.page_id or 0, r.is_listed, r.verdict) for r in out.collect())
    assert got == [(0, True, "block"), (1, True, "block"), (2, True, "block"), (3, False, "allow"), (4, False, "allow"), (5, False, "allow"), (6, True, "allow"), (7, False, "block"), (8, True, "block"), (8, True, "block")]
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    sql = con.execute(urls.OP3_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(map(repr, sql)) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())
