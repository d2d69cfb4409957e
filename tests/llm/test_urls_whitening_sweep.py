"""Operators 11 to 13 against brute-force versions, and their awkward rows."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import sweep as sweeping
from lodestar.llm import url_list
from lodestar.llm.common import Scratch
from lodestar.llm.sweep import EVERYWHERE, UNKNOWN, open_sales, sweep
from lodestar.llm.url_list import build_list, judge_urls, mostly_blocked
from lodestar.llm.whitening import Moments, symmetric_qr, whiten

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))
    host_end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:host_end])
    return host, rest[host_end:end]


def judged_by_hand(url, rules, listed=()):
    host, path = parts_of(url)

    def fits(key, path):
        h, _, p = key.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    best = max((r for r in rules if fits(r[0], path)), key=lambda r: (len(r[0]), r[0].index("/")), default=None)
    if best:
        return host, path, best[0], best[1]
    return host, path, None, "block" if any(fits(k, path or "/") for k, v in listed if v == "block") else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://a.org/", "HTTP://EXAMPLE.ORG/es/1", "https://x.example.org/es", "https://example.org/en/12?u=http://com/de/",
    "http://myexample.org/es/1", "http://a.com/fr/1#x", "http://com/de/", "http://b.com/de/2", "http://b.com/en/9", "http://b.com", "http://sub.b.com?q", "http://c.net/ü/ß",
    "ftp://Ä.COM/de/1", "http://a..com/de/1", "http://x.org:80/a", "http://x.example.org/en/1", "http://" + "long." * 300 + "org/" + "p" * 5000, "a://b://c.org/d",
]


def test_urls_are_judged_as_by_hand(spark):
    scratch = Scratch(spark)
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[:4])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = build_list(spark.createDataFrame(RULES, "key string, verdict string"), scratch)
    listed = [("b.com/", "block"), ("b.com/", "allow"), ("c.net/", "allow"), (None, "block"), ("/nohost", "block"), ("noslash", "block")]
    black = build_list(spark.createDataFrame(listed, "key string, verdict string"), scratch)
    found = judge_urls(pages, "url", rules, black)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    told = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert told == {i: judged_by_hand(u, RULES, listed[:3]) for i, u, _ in rows}
    bad = {r["key"] for r in mostly_blocked(judge_urls(pages, "url", rules)).collect()}
    ruled = [x for x in (judged_by_hand(u, RULES) for _, u, _ in rows) if x[2]]
    shares = {h: [x[3] == "block" for x in ruled if x[0] == h] for h in {x[0] for x in ruled}}
    assert bad == {h + "/" for h, x in shares.items() if 2 * sum(x) > len(x)} and len(bad) > 3
    scratch.close()


def test_many_shards_and_colliding_digests(spark, monkeypatch):
    scratch, rng = Scratch(spark), random.Random(3)
    keys = sorted({f"h{rng.randrange(400)}.example/{'abc'[: rng.randrange(4)]}" for _ in range(600)})
    entries = [(k, rng.choice(["allow", "block"])) for k in keys]
    rows = [(i, f"http://w.h{rng.randrange(500)}.example/abcd") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for crowded in (False, True):
        if crowded:  # 8 digests in all: every probe meets other keys' texts
            monkeypatch.setattr(url_list, "digest", lambda key: F.shiftleft(F.pmod(F.xxhash64(key), F.lit(8)).cast("long") - 4, 61))
        made = build_list(spark.createDataFrame(entries, "key string, verdict string"), scratch, shard_keys=100)
        assert made.bits == 3 and sum(made.sizes.values()) == len(keys) and len(made.sizes) > 4
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, "url", made).collect()}
        assert got == {i: judged_by_hand(u, entries)[2:] for i, u in rows}
    scratch.close()


def test_empty_list_and_empty_pages(spark):
    scratch = Scratch(spark)
    none = build_list(spark.createDataFrame([], "key string, verdict string"), scratch)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, "url", none, none).collect()] == [(1, "http://a.org/x", "a.org", "/x", None, "allow")]
    assert judge_urls(pages.limit(0), "url", none).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        url_list.mounted("hdfs://name/folder")
    scratch.close()


def test_symmetric_qr_finds_eigenpairs():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        for rank in (n, max(1, n // 2)):
            half = rng.normal(size=(n, rank))
            matrix = half @ half.T
            values, vectors = symmetric_qr(matrix)
            assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], atol=1e-10 * values[0])
            assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12) and np.allclose(matrix @ vectors, vectors * values, atol=1e-10 * values[0])
    assert np.allclose(symmetric_qr(np.diag([1.0, 3.0, 2.0]))[0], [3, 2, 1])
    assert np.allclose(symmetric_qr(np.zeros((4, 4)))[0], 0)


def test_moments_merge_as_streamed():
    rng = np.random.default_rng(6)
    rows = rng.integers(-500, 500, size=(300, 5))
    whole, left, right = Moments.none(5), Moments.none(5), Moments.none(5)
    whole.update(rows), left.update(rows[:37]), right.update(rows[37:])
    left.merge(right), left.merge(Moments.none(5))
    for m in (whole, left):
        assert m.n == 300 and (m.sums == rows.sum(axis=0)).all() and np.allclose(m.covariance(), np.cov(rows.T, bias=True), rtol=1e-12)


def test_whitening_against_numpy(spark):
    scratch, rng = Scratch(spark), np.random.default_rng(7)
    base = rng.normal(size=(400, 12)) * np.linspace(0.05, 0.6, 12)
    rows = [(i, [float(np.float32(c)) for c in v], "x") for i, v in enumerate(base)] + [(500, [0.25] * 12, "x"), (500, [0.25] * 12, "x"), (None, [0.1] * 12, "x")]
    broken = [(900, None, "x"), (901, [], "x"), (902, [0.1] * 11 + [None], "x"), (903, [math.nan] * 12, "x"), (904, [math.inf] + [0.0] * 11, "x"), (905, [0.1] * 5, "x"), (906, [1e30] + [0.0] * 11, "x")]
    df = spark.createDataFrame(rows + broken, "vec_id long, embedding array<float>, component string").repartition(40)
    got = whiten(df, scratch).collect()
    x = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, (key, own) in enumerate(zip([r[0] for r in rows], x, strict=True)):
        for c in range(8):
            want = (own - sums / n) @ vectors[:, c] / np.sqrt(values[c])
            if key == 0:
                signs[c] = np.sign(want) * np.sign(by[0, c + 1][0]["whitened"])
            r = by[key, c + 1][0]
            assert abs(r["whitened"] * signs[c] - want) < 1e-9 and abs(r["explained"] - values[c] / values.sum()) < 1e-12
            assert r["deviation"] == int(((n * own - sums) ** 2).sum()) and r["identity_error"] < 1e-10
    scratch.close()


def test_whitening_of_few_or_equal_vectors(spark):
    scratch = Scratch(spark)

    def count(rows):
        return whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scratch).groupBy("component").count().count()

    assert count([]) == 0 and count([(1, None)]) == 0 and count([(1, [0.5, 0.25])]) == 0 and count([(i, [0.5, 0.25]) for i in range(9)]) == 0
    assert count([(1, [0.5, 0.25, 0.0]), (2, [0.1, 0.2, 0.0])]) == 1
    assert count([(1, [0.5]), (2, [0.25]), (3, [0.0])]) == 1
    scratch.close()


def swept_by_hand(intervals):
    changes = {}
    for nation, start, end, cents in intervals:
        for key in (nation, EVERYWHERE):
            changes.setdefault(key, {}).setdefault(start, []).append((1, cents))
            if end is not None:
                changes[key].setdefault(end, []).append((-1, -cents))
    out = []
    for nation, moments in changes.items():
        n = c = 0
        rows = []
        for t in sorted(moments):
            dn, dc = sum(x for x, _ in moments[t]), sum(x for _, x in moments[t])
            if dn or dc:
                n, c = n + dn, c + dc
                rows.append((t, n, c))
        top = max((r[2] for r in rows), default=0)
        for i, (t, n, c) in enumerate(rows):
            out.append((nation, t, rows[i + 1][0] if i + 1 < len(rows) else None, n, c, max(r[1] for r in rows[: i + 1]), c == top))
    return sorted(out)


@pytest.mark.parametrize("bits", [4, 17])
def test_sweep_against_brute_force(spark, monkeypatch, bits):
    """Few and many ranges, several supers, more pieces than one round merges, tiny buffers."""
    monkeypatch.setattr(sweeping, "RANGE_BITS", bits)
    monkeypatch.setattr(sweeping, "RANGE_SECONDS", 1 << bits)
    monkeypatch.setattr(sweeping, "SUPER_BITS", 3)
    monkeypatch.setattr(sweeping, "GATHER_ROWS", 10)
    monkeypatch.setattr(sweeping, "BUFFER", 30)
    rng = random.Random(bits)
    rows = []
    for _ in range(900):
        start = rng.choice([7, rng.randrange(-2_000, 2_000), rng.randrange(-(10**7), 10**7)])
        rows.append((rng.choice([7, 7, 1, UNKNOWN]), start, rng.choice([None, start + 1, start + rng.randrange(1, 3000)]), rng.choice([0, 5, -3, 10**9])))
    rows += [(3, 10, 20, 4), (3, 20, 30, 4), (4, 1, 2, 0)]
    scratch = Scratch(spark)
    df = spark.createDataFrame(rows, "nation int, start long, end long, cents long").repartition(23)
    assert sorted(map(tuple, sweep(df, scratch).collect()), key=lambda r: r[:2]) == swept_by_hand(rows)
    assert sweep(df.limit(0), scratch).collect() == []
    scratch.close()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_open_sales_awkward_rows(spark, zone):
    scratch, day = Scratch(spark), timedelta(days=1)
    t = datetime(2024, 3, 10, 2, 30, 0, 999_999)
    sales = [
        (1, 1, 10.005, t, "a"), (2, None, None, t, "a"), (3, 99, float("nan"), t, "a"), (4, 2, -1.0, None, "a"), (None, 1, 1.0, t, "a"), (5, 3, float("inf"), t, "a"),
        (6, 1, 2.0, t, "a"), (6, 1, 2.0, t, "a"), (7, 1, 3.0, t, "a"), (8, 1, 4.0, datetime(1969, 12, 31, 23, 59, 59, 500_000), "a"),
    ]
    lines = [(1, t + day, 1), (1, None, 1), (1, t + 2 * day, 1), (6, t - day, 1), (7, t - day + timedelta(seconds=1), 1), (None, t, 1), (2, None, 1)]
    clients = [(1, 5, 0), (2, 6, 0), (3, None, 0), (1, 9, 0), (None, 8, 0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frames = (
            spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, nation string"),
            spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz, start int"), spark.createDataFrame(clients, "client_id long, nation_id int, sale_id int"),
        )
        got = sorted(map(tuple, open_sales(*frames, scratch).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    s = int((datetime(2024, 3, 10, 2, 30) - datetime(1970, 1, 1)).total_seconds())
    want = [(5, s, s + 2 * 86_400, 1001), (UNKNOWN, s, None, 0), (UNKNOWN, s, None, 0), (5, s, None, 100), (UNKNOWN, s, None, 0), (5, s, s + 1, 300), (5, -1, None, 400)]
    assert got == sorted(want, key=repr)
    scratch.close()
