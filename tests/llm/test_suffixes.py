"""Registered domains under suffixes from a table, and hosts with a port."""

from __future__ import annotations

from migraspark.llm.url_filter import url_filter, with_domain

HOSTS = {
    "www.a.co.nz": ("a.co.nz", "co.nz"),
    "b.co.nz:8080": ("b.co.nz", "co.nz"),
    "co.nz": ("co.nz", "co.nz"),
    "x.y.me.github.io": ("me.github.io", "github.io"),
    "a.b.c.ck": ("b.c.ck", "c.ck"),
    "q.www.ck": ("www.ck", "ck"),
    "www.site.com:80": ("site.com", "com"),
    "localhost": ("localhost", "localhost"),
    "": ("", ""),
}


def test_domains_by_a_table_of_suffixes(spark):
    rules = spark.createDataFrame([(s,) for s in ("nz", "CO.nz", "github.io", "*.ck", "!www.ck", "com")], "suffix string")
    hosts = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    found = {r.host: (r.domain, r.suffix) for r in with_domain(hosts, rules).collect()}
    assert found == HOSTS
    default = {r.host: (r.domain, r.suffix) for r in with_domain(hosts).collect()}
    assert default["www.a.co.nz"] == ("co.nz", "nz") and default["www.site.com:80"] == ("site.com", "com")


def test_a_port_does_not_hide_the_domain(spark):
    rows = [(i, f"http://{'bad' if i < 40 else f'h{i % 30}'}.org/{i}") for i in range(400)]
    pages = spark.createDataFrame([*rows, (5000, "http://sub.bad.org:8080/")], "page_id bigint, url string")
    outcomes = pages.where("page_id < 5000").selectExpr("page_id", "page_id < 40 AS bad")
    found = {r.page_id: r for r in url_filter(pages, outcomes).collect()}
    assert found[5000].host == "sub.bad.org:8080" and found[5000].host_labelled == 0
    assert found[5000].verdict == "block" and found[0].verdict == "block" and found[100].verdict == "allow"
