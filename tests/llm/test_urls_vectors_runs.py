"""URL filter, whitening and periodic runs held against brute force, and their defined edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from chesslake.llm import periodic_runs, registry, url_filter, whitening

# 11 URL filter


def brute_judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(raw) :]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    path = re.match(r"[^?#]*", tail)[0]
    fitting = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=(0, 0, None, None))
    return host, path, best[2], best[3], re.sub("[0-9]", "0", host + tail)


def brute_filter(urls, share):
    """(host, path, rule, verdict, score) of every URL, by the recursion over contexts."""
    rows = [brute_judged(u) for u in urls]
    held = [hashlib.md5(r[0].encode()).hexdigest()[0] in url_filter.SHARE_HELD for r in rows]
    counts = {"allow": collections.Counter(), "block": collections.Counter()}
    for r, h in zip(rows, held):
        s = "\x02" + r[4] + "\x03"
        if r[3] and not h:
            for i in range(1, len(s)):
                for a in range(max(0, i - url_filter.ORDER), i + 1):
                    counts[r[3]][s[a : i + 1]] += 1
    totals = {k: sum(n for g, n in c.items() if len(g) == 1) for k, c in counts.items()}
    kept = {g for k, c in counts.items() for g, n in c.items() if n >= share * totals[k]}
    followers = {k: collections.defaultdict(list) for k in counts}
    for g in kept:
        for k, c in counts.items():
            if c[g]:
                followers[k][g[:-1]].append(c[g])

    def chance(k, context, symbol):
        below = chance(k, context[1:], symbol) if context else 1 / url_filter.ALPHABET
        n = totals[k] if not context else counts[k]["\x03"] if context == "\x02" and "\x03" in kept else counts[k][context]
        if context and context != "\x02" and context not in kept or not n:
            return below
        own = followers[k][context]
        return ((counts[k][context + symbol] if context + symbol in kept else 0) + (n - sum(own) + len(own)) * below) / (n + len(own))

    out = []
    for r in rows:
        s = "\x02" + r[4] + "\x03"
        d = sum(math.log(chance("allow", s[max(0, i - url_filter.ORDER) : i], s[i])) - math.log(chance("block", s[max(0, i - url_filter.ORDER) : i], s[i])) for i in range(1, len(s)))
        out.append(d / (len(s) - 1))
    micro = [math.floor(x * 1e6 + 0.5) for x in out]
    own = [(m // 1000, r[3]) for m, r, h in zip(micro, rows, held) if h and r[3]]
    a, b = sum(v == "allow" for _, v in own), sum(v == "block" for _, v in own)
    edges = {0} | {x for x, _ in own} | {x + 1 for x, _ in own}
    least = min(edges, key=lambda e: (-(sum(x >= e and v == "allow" for x, v in own) * b + sum(x < e and v == "block" for x, v in own) * a), abs(e), e))
    return [(r[0], r[1], r[2], r[3] or ("allow" if m >= 1000 * least else "block"), m / 1e6) for r, m in zip(rows, micro)]


def url_rows(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_url_rules():
    told = {
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/"), "http://www.example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/"), "ftp://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"), "http://example.com": ("example.com", "", None), "http://com/": ("com", "/", "com/"), "http://net/es/": ("net", "/es/", "net/es/"), "http://a.net/ES/": ("a.net", "/ES/", None),
        "http://a.net/fr/://b.com/": ("a.net", "/fr/://b.com/", "net/fr/"), "no scheme": ("", "", None), None: ("", "", None), "http://a.com?x=/en/": ("a.com", "", None), "://": ("", "", None),
    }
    assert {u: brute_judged(u)[:3] for u in told} == told


@pytest.mark.parametrize("share", [url_filter.SHARE, 0.02])
def test_url_filter_matches_brute_force(spark, sf, share):
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    urls += [None, "", "nothing", "://", "http://", "http://EXAMPLE.com/en/1", "http://a.net/fr/x?y#z", "http://www.example.com", "http://é.example.org/ñ/你好", "http://x.net/es/" + "ab/" * 3000, "http://q.net/en/\n#", *["http://same.example.com/de/1"] * 40]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(url_rows(spark, urls), share=share).collect()}
    want = brute_filter(urls, share)
    assert len(got) == len(urls)
    for i, w in enumerate(want):
        assert got[i][:4] == w[:4], urls[i]
        assert abs(got[i][4] - w[4]) < 2e-6


def test_url_filter_without_labels(spark):
    for urls in ([], [None, "http://a.org/en/1"], ["http://a.com/x/1", "http://b.org/"]):
        rows = url_filter.filter_urls(url_rows(spark, urls).selectExpr("page_id", "url", "1 AS id", "2 AS text", "3 AS gram", "4 AS ruled")).collect()
        assert sorted(r["page_id"] for r in rows) == list(range(len(urls)))
        assert all(r["verdict"] in ("allow", "block") for r in rows)


def test_url_filter_tells_kinds_apart(spark):
    """Hosts without a rule that look like accepted or rejected ones are judged so."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = "abcde", "vwxyz"
    urls = [f"http://{word(good)}.com/{word(good)}/{rng.randint(0, 999)}" for _ in range(200)] + [f"http://{word(bad)}.net/es/{word(bad)}" for _ in range(200)]
    fresh = [(f"http://{word(of)}.org/{word(of)}", v) for of, v in ((good, "allow"), (bad, "block")) for _ in range(50)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(url_rows(spark, urls + [u for u, _ in fresh])).collect()}
    assert sum(got[len(urls) + i] == v for i, (_, v) in enumerate(fresh)) >= 97


# 12 whitening


def brute_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + whitening.SHIFT for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(v) for v in ((n * x - s) ** 2).sum(1)]
    centred = ((n * x - s) / n).astype(float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation, centred @ u / np.sqrt(e), e / np.trace(v)


def vector_rows(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def held_against_brute(rows, vectors, k):
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, white, explained = brute_whitening(vectors, k)
    k = white.shape[1]
    got = np.array([r["whitened"] for r in rows]).reshape(n, k)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert [r["component"] for r in rows] == list(range(1, k + 1)) * n
    assert [r["deviation"] for r in rows[::k]] == deviation
    assert {r["n"] for r in rows} == {n}
    assert max(abs(r["explained"] - x) for r, x in zip(rows, list(explained) * n)) < 1e-12
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9


def test_whitening_matches_numpy(spark, sf):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    held_against_brute(registry.QUERIES["op12_whitening"](spark, sf).collect(), vectors, 32)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = [v.tolist() for v in (rng.standard_normal((60, 5)) * [1, 2, 3, 4, 5] + 1000)]
    vectors += [vectors[0]] * 30  # repeated rows
    odd = [None, [], [None] * 5, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = vector_rows(spark, vectors).unionByName(vector_rows(spark, odd, 1000))
    got = whitening.whiten(rows.selectExpr("vec_id", "embedding", "1 AS x", "2 AS n", "3 AS component")).collect()
    assert {r["vec_id"] for r in got} == set(range(90))
    held_against_brute(got, vectors, 32)
    same = collections.Counter((r["component"], r["whitened"]) for r in got if r["vec_id"] == 0 or r["vec_id"] >= 60)
    assert set(same.values()) == {31}


def test_whitening_without_spread(spark):
    assert whitening.whiten(vector_rows(spark, [])).count() == 0
    assert whitening.whiten(vector_rows(spark, [None, []])).count() == 0
    for vectors in ([[1.0, 2.0]], [[0.5, 0.25]] * 4):
        rows = whitening.whiten(vector_rows(spark, vectors)).collect()
        assert len(rows) == 2 * len(vectors) and {(r["deviation"], r["whitened"], r["identity_error"]) for r in rows} == {(0, None, None)}
    flat = whitening.whiten(vector_rows(spark, [[0.0, 1.0], [0.0, 2.0], [0.0, 5.0]])).collect()  # one dimension varies
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 3 + [True] * 3
    big = whitening.whiten(vector_rows(spark, [[2.0**39, 1.0], [-(2.0**39), 5.0], [1.0, 2.0]])).collect()
    assert all((r["deviation"] is None) == (r["vec_id"] < 2) for r in big)  # beyond a long


@pytest.mark.parametrize("d,k,spectrum", [(64, 32, "near"), (200, 10, "linear"), (300, 16, "falling"), (50, 8, "equal"), (40, 12, "few"), (1, 1, "equal")])
def test_jacobi_davidson_matches_dense(d, k, spectrum):
    rng = np.random.default_rng(d)
    e = {"near": np.linspace(66, 58, d), "linear": np.linspace(1, 50, d), "falling": 10 * np.exp(-np.arange(d) / 20), "equal": np.ones(d), "few": np.r_[np.ones(4), np.zeros(max(0, d - 4))][:d]}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.jacobi_davidson(lambda u: a @ u, d, k)
    assert np.abs(values - np.sort(e)[::-1][:k]).max() < 1e-12 * e.max()
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 2e-13 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_minres_solves_projected_equations():
    rng = np.random.default_rng(8)
    d, a = 6, np.diag([9.0, 5.0, 3.0, 2.0, 1.0, 0.5])
    q = np.eye(d)[:, :1]
    r = rng.standard_normal((d, 2))
    r[0] = 0
    theta = np.array([9.0, 8.5])
    t = whitening.minres(lambda u: a @ u, theta, q, r)
    for j in range(2):
        exact = np.zeros(d)
        exact[1:] = np.linalg.solve(a[1:, 1:] - theta[j] * np.eye(d - 1), -r[1:, j])
        assert np.linalg.norm((a - theta[j] * np.eye(d)) @ (t[:, j] - exact)) <= whitening.INNER_LEFT * np.linalg.norm(r[:, j]) + 1e-9


# 13 periodic runs


def brute_runs(w):
    best = {}
    for p in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - p:
            j = k
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > k and j - k + p >= max(24, 3 * p):
                best.setdefault((k, j + p), p)
            k = j + 1
    return sorted((x, y - x, p) for (x, y), p in best.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    return (doc_id, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_match_brute_force(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 3000]
    assert len(rows) > 150
    got = {r["doc_id"]: tuple(r) for r in registry.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    for r in rows:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])
    assert sum(g[1] > 0 for g in got.values()) >= 10


def made_up(rng):
    kind, n = rng.random(), rng.randint(0, 400)
    if kind < 0.3:
        return [rng.choice("ab" if kind < 0.2 else "aaaaaaaaab") for _ in range(n)]
    out = []
    while len(out) < n:
        q = rng.choice([1, 2, 3, 5, 7, 11, 12, 13, 16, 17, 20, 24, 28, 30, 33, 45, 48, 60, 90, 120])
        period = [rng.choice(rng.choice(["ab", "abc", "abcdefghijklmnop"])) for _ in range(q)]
        if rng.random() < 0.4 and q > 8:  # of a smaller period for the most part
            r, k = rng.randint(1, 5), rng.randint(q // 2, q - 1)
            period[:k] = (period[:r] * (k // r + 1))[:k]
        out += (period * 7)[: int(q * rng.uniform(1.5, 6))] + [rng.choice("xyz") for _ in range(rng.choice([0, 0, 1, 4]))]
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_runs_of_made_up_words():
    rng = random.Random(13)
    for _ in range(120):
        docs = [made_up(rng) for _ in range(rng.randint(1, 6))] + [fibonacci(rng.randint(30, 500))]
        _, got = periodic_runs.find_runs([" ".join(d).encode() for d in docs])
        assert got == [brute_runs(d) for d in docs]


def test_runs_survive_colliding_hashes(monkeypatch):
    """Hashes propose; what they say is compared word by word."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x % np.uint64(5))
    rng = random.Random(5)
    for _ in range(20):
        words = made_up(rng)
        found = periodic_runs.find_runs([" ".join(words).encode()])[1][0]
        assert set(found) <= set(brute_runs(words))


def test_long_runs_are_linear():
    words = [str(i) for i in range(40_000)] * 6 + ["x", "y", "z"] * 100_000
    assert periodic_runs.find_runs([" ".join(words).encode()])[1][0] == [(0, 240_000, 40_000), (240_000, 300_000, 3)]


def test_periodic_runs_on_hostile_tables(spark, hostile, nothing):
    got = periodic_runs.periodic_runs(hostile, plant=True).collect()
    texts = hostile.select("doc_id", "text").collect()
    short = {(r["doc_id"], r["text"]) for r in texts if len(r["text"] or "") < 20_000}
    counts = collections.Counter(tuple(r) for r in got)
    want = collections.Counter(brute_row(r["doc_id"], r["text"]) for r in texts if (r["doc_id"], r["text"]) in short)
    assert want <= counts and len(got) == len(texts)
    assert periodic_runs.periodic_runs(nothing).count() == 0
    kept = {r["doc_id"]: r["text"] for r in periodic_runs.collapse_runs(spark.createDataFrame([(1, "a b " * 30), (2, None), (3, "one  two")], "doc_id long, text string")).collect()}
    assert kept == {1: "a b", 2: None, 3: "one two"}
