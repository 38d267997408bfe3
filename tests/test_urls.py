from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from relinker.functions import urls

CASES = [
    (urls.clean_url, "https://h.com/My-Page_one/sub%20x/?a=1#f", "my page one sub x"),
    (urls.clean_url, "", ""),
    (urls.clean_url, None, ""),
    (urls.clean_url, "https://h.com/a/b;z=1&c=2", "a b?c=2&z=1"),
    (urls.clean_url, "https://h.com/100%/a+b", "100% a+b"),
    (urls.remove_utm, "https://h.com/p/q;z=1?utm_source=a&id=3#f", "https://h.com/p/q"),
    (urls.remove_utm, "https://h.com/p?id=3#f", "https://h.com/p?id=3#f"),
    (urls.strip_invalid, "  https://h.com/a​b\t ", "https://h.com/ab"),
    (urls.path_segments, "https://h.com//a/b/", ["a", "b"]),
    (urls.path_segments, None, []),
    (urls.url_extension, "/a/B.HTML", ".html"),
    (urls.url_extension, "/a/.htaccess", ""),
    (urls.url_extension, "/x.tar.gz", ".gz"),
    (urls.url_extension, "/a/", ""),
    (urls.query_param_names, "?x=1&x=2&y=&z=3", ["x", "z"]),
    (urls.query_param_names, "?a%20b=1&c+d=2", ["a b", "c d"]),
    (urls.url_language, "https://h.com/fr/1", "fr"),
    (urls.url_language, "https://h.com/fra/1", "unknown"),
    (urls.url_language, None, "unknown"),
    (urls.parent_url, "https://h.com/a/b?x#y", "https://h.com/a/"),
    (urls.parent_url, "https://h.com/a/", "https://h.com/"),
    (urls.parent_url, "https://h.com/", None),
    (urls.parent_url, "https://h.com", None),
    (urls.token_sort_key, "https://h.com/b-a_c", "a_c b com h https"),
    (urls.nlp_text, "a/b-c_d.e", "a b c d e"),
    (urls.char_set_text, "banana", "abn"),
    (urls.domain_key, "https://www.shop.example.com/a", "shop_example_com"),
]


def test_scalar_goldens(spark):
    for i, (function, text, want) in enumerate(CASES):
        df = spark.createDataFrame([(text,)], "url string")
        assert df.select(function("url").alias("x")).first()["x"] == want, (i, text)


def test_split_agrees_with_the_standard_library(spark):
    texts = [
        "https://h.com/a/b;p?x=1&y=2#z", "HTTP://U@h:8/p;q/r;s", "/only/path", "mailto:a@b", "", "//h/x", "a b/c?d",
        "https://h.com?q#f#g", "https://h.com/ä/ö.html",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "url string")
    rows = df.select("url", urls.url_scheme("url"), urls.url_host("url"), urls.url_path("url"), urls.url_params("url"),
                     urls.url_query("url"), urls.url_fragment("url")).collect()
    for r in rows:
        assert tuple(r)[1:] == tuple(urlparse(r[0])), r[0]
    names = df.select("url", urls.query_param_names("url").alias("n")).collect()
    assert all(sorted(r["n"]) == sorted(parse_qs(urlparse(r["url"]).query)) for r in names)


@pytest.mark.parametrize("text, want", [("a", []), ("ab", ["ab"]), ("ABc", ["ab", "bc", "abc"]), ("a \t b", ["a ", " b", "a b"])])
def test_char_ngrams(spark, text, want):
    df = spark.createDataFrame([(text,)], "url string")
    assert df.select(urls.char_ngrams("url", 2, 3).alias("g")).first()["g"] == want
