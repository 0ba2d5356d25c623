import pytest
from pyspark.sql import functions as F

from pipequery import functions as fn

URLS = {
    "https://www.google.com/a?b": "google.com", "http://a.b.co.uk:80/": "b.co.uk", "co.uk": "", "https://1.2.3.4/x": "", "localhost": "", "https://u:p@x.cloudflare.com.": "cloudflare.com", "": "",
}


def test_domains_agree(spark):
    rows = spark.createDataFrame([(u,) for u in [*URLS, None]], "url string").select("url", fn.registered_domain(F.col("url")).alias("d")).collect()
    assert {r["url"]: r["d"] for r in rows} == {**URLS, None: None}
    assert {u: fn.parse_domain(u) for u in URLS} == URLS


def test_register_by_path_is_null_safe(spark):
    fn.register(spark, "domain_of", "pipequery.functions.parse_domain")
    assert [r[0] for r in spark.sql("SELECT domain_of(x) FROM VALUES ('a.example.org'), (NULL) AS t(x)").collect()] == ["example.org", None]
    with pytest.raises(TypeError):
        fn.return_type(lambda x: x)


def test_inet(spark):
    fn.register_builtin(spark)
    [row] = spark.sql("SELECT inet('10.0.0.9') < inet('10.0.1.0') a, inet('::1') < inet('2001:db8::') b, inet('x') c").collect()
    assert tuple(row) == (True, True, None)
    assert spark.sql("SELECT '10.0.1.2' ip").select(fn.inet4(F.col("ip"))).first()[0] == (10 << 24) + 258
