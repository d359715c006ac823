from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import queries, urls

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    "no scheme.example.org/es/",
    "http://",
    "http://example.org",
    "http://EXAMPLE.org/es/?x=/fr/",
    "https://a.example.org/es",
    "https://notexample.org/en/1",
    "https://example.org/en/1",
    "x://y://example.org/en/1",
    "http://fr.com/fr/x#y",
    "http://com/de/",
    "http://.com/de/é\n",
    "http://a..org//",
    "http://example.org/en/12/",
    "http://example.org/en/12/",
    "http://" + "a." * 500 + "com/fr/" + "x" * 50_000,
]


def judged(url, allow, block):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for verdict, rules in (("allow", allow), ("block", block)):
        for rule in rules:
            name, slash, begin = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + begin):
                fits.append((len(rule), rule, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, "allow")
    return host, path, rule, verdict


def check(rows, given, allow=queries.ALLOW, block=queries.BLOCK):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows), key=repr)
    assert got == sorted(((i, *judged(url, allow, block)) for i, url in given), key=repr)


def test_odd_urls_and_clashing_columns(spark):
    given = list(enumerate(ODD)) + [(None, ODD[8])]
    frame = spark.createDataFrame(given, "page_id bigint, url string").selectExpr("*", "url AS host", "1 AS rule", "2 AS key")
    check(urls.judge(frame, "url", queries.ALLOW, queries.BLOCK).collect(), given)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(frame, "url", queries.ALLOW, queries.BLOCK).collect() == []


def test_no_rule_is_met(spark):
    given = [(1, "http://example.net/")]
    frame = spark.createDataFrame(given, "page_id bigint, url string")
    check(urls.judge(frame, "url", ["org/"], ["com/"]).collect(), given, ["org/"], ["com/"])


@pytest.mark.parametrize("probes", [urls.LEAST_PROBES, 1])
def test_many_rules_need_several_levels(spark, monkeypatch, probes):
    monkeypatch.setattr(urls, "LEAST_PROBES", probes)
    rnd = random.Random(3)
    hosts = [f"h{i}.example.{rnd.choice(['com', 'net'])}" for i in range(3000)]
    given = [(i, f"https://{host}/{rnd.choice('abc')}/{i}") for i, host in enumerate(hosts)]
    rules = [f"{host}/{rnd.choice('abc')}" for host in rnd.sample(hosts, 1200)]
    allow, block = rules[:600], rules[600:]
    frame = spark.createDataFrame(given, "page_id bigint, url string")
    check(urls.judge(frame, "url", allow, block).collect(), given, allow, block)


def test_keys_of_one_hash_are_told_apart(spark, monkeypatch):
    """With the first two seeds a listed and another key collide."""
    real, seeds = urls._hash, []

    def crowded(key, seed):
        seeds.append(seed)
        return F.length(key).cast("bigint") if seed < 2 else real(key, seed)

    monkeypatch.setattr(urls, "_hash", crowded)
    given = [(1, "http://example.org/a/"), (2, "http://example.net/a/"), (3, "http://example.org/b/"), (4, None)]
    frame = spark.createDataFrame(given, "page_id bigint, url string")
    allow, block = ["example.org/a/", "example.org/a/"], ["example.net/"]
    check(urls.judge(frame, "url", allow, block).collect(), given, allow, block)
    assert max(seeds) == 2


@pytest.mark.parametrize("others", [1_000, 300_000])
def test_filters_grow_with_the_list_not_the_universe(spark, others):
    listed = 20
    universe = spark.range(others + listed).selectExpr("xxhash64(id) AS h", f"id < {listed} AS listed")
    cascade = urls.build_cascade(universe)
    assert all(len(level.bits) * 8 <= 3 * listed * others.bit_length() for level in cascade[:1])
    assert sum(len(level.bits) for level in cascade) < 400
    hashes = np.array([row["h"] for row in universe.select("h").collect()])
    assert urls.listed(cascade, hashes).sum() == listed
    assert urls.listed(cascade, hashes[:listed]).all()


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("xxhash64(id) AS h", "id % 7 = 0 AS listed")
    cascade = urls.build_cascade(universe)
    rows = universe.collect()
    answer = urls.listed(cascade, np.array([row["h"] for row in rows]))
    assert len(cascade) > 1
    assert answer.tolist() == [row["listed"] for row in rows]


def test_query(spark):
    given = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    check(queries.op5_url_cascade(spark, SF_DIR).collect(), given)
