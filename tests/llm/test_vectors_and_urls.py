"""Vector codes, whitening and URL filters against plain versions, with the edge cases of each."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm.url_filter import judge_urls, link_targets, with_rules
from inkwell.llm.vector_codes import Codebook, book_digest, code_report, integers, squares, vector_codes
from inkwell.llm.whitening import Fit, refined_eigen, whitened

NAMES = ("dim", "id", "v", "codes", "error", "part", "entry", "n", "at", "sum", "named", "key", "host", "rule", "action", "known", "url_key", "cls", "component", "source", "target", "text")


def clashing(df):
    for name in NAMES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def plain_codes(rows):
    """(id, label, vector) of one dimension to (id, code, error, label_error, digest) in plain numpy."""
    x = np.stack([np.floor(np.array(v, np.float64) * 1024).astype(np.int64) for _, _, v in rows])
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:256]
    parts = np.split(x, 4, axis=1)
    books = [p[order].copy() for p in parts]
    nearest = lambda p, b: ((p[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    for _ in range(4):
        for p, b in zip(parts, books, strict=True):
            code = nearest(p, b).argmin(axis=1)
            for e in np.unique(code):
                own = p[code == e]
                b[e] = [int(s) // len(own) for s in own.sum(axis=0)]
    found = [nearest(p, b) for p, b in zip(parts, books, strict=True)]
    codes, errors = [d.argmin(axis=1) for d in found], sum(d.min(axis=1) for d in found)
    by = defaultdict(int)
    for (_, label, _), e in zip(rows, errors, strict=True):
        by[label] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by[label], digest) for k, (i, label, _) in enumerate(rows)]


@pytest.mark.parametrize("n,dim,spread", [(700, 8, 0.05), (300, 6, 1.0), (40, 4, 1.0), (900, 16, 900.0)])
def test_codes_against_plain_k_means(spark, n, dim, spread):
    rng = np.random.RandomState(n)
    centres = rng.standard_normal((12, dim))
    v = np.round(centres[rng.randint(0, 12, n)] * spread + rng.standard_normal((n, dim)) * spread / 8, 3)
    v[5:9] = v[4]  # ties between entries
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), x.tolist()) for i, x in zip(rng.permutation(n), v, strict=True)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in code_report(df).collect())
    assert got == sorted(plain_codes(rows))


def test_rings_compare_less_and_find_the_same():
    rng = np.random.RandomState(3)
    centres = rng.randint(-900, 900, (64, 8))
    points = centres[rng.randint(0, 64, 5000)] + rng.randint(-40, 41, (5000, 8))
    first = Codebook(centres)
    codes, errors = first.assign(points)
    later = centres + rng.randint(-6, 7, centres.shape)
    radii = [int(np.sqrt(errors[codes == e].max(initial=0))) + 2 + int(np.sqrt(((later[e] - centres[e]) ** 2).sum())) + 1 for e in range(64)]
    ball, whole = Codebook(later, np.array(radii, object)), Codebook(later)
    for a, b in zip(ball.reassign(points, codes), whole.assign(points), strict=True):
        assert (a == b).all()
    assert ball.compared < whole.compared / 5


def test_distances_are_exact_beyond_doubles():
    p, e = np.array([[1 << 29, 3], [-(1 << 29), 1]]), np.array([[-(1 << 29), 2], [0, 0]])
    assert squares(p, e).tolist() == [[(1 << 60) + 1, (1 << 58) + 9], [1, (1 << 58) + 1]]
    assert np.abs(integers(np.array([1e30, -1e30, 0.5, -1e-9]), 4).reshape(-1)).max() == 1 << 29


def test_codes_edges(spark):
    bad = [(1, 0, None), (2, 0, [float("nan"), 1.0]), (3, 0, [None, 1.0]), (4, 0, [float("-inf"), 1.0])]
    fine = [(9, 1, [1.0, 2.0, 3.0, 4.0]), (9, 1, [1.0, 2.0, 3.0, 4.5]), (None, None, [0.0] * 4), (5, 1, [0.0] * 4), (5, 1, [0.0] * 4)]
    other = [(7, 2, [0.5]), (8, 2, [0.25])]
    empty = [(6, 3, [])]
    df = clashing(spark.createDataFrame(bad + fine + other + empty, "vec_id long, label int, embedding array<float>"))
    got = {(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in code_report(df).collect()}
    assert got == set(plain_codes(fine)) | set(plain_codes(other)) | {(6, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())}
    assert code_report(df).count() == 8
    assert code_report(df.limit(0)).count() == 0
    coded, books = vector_codes(df.filter("vec_id = 7"), rounds=1)
    assert coded.columns == ["vec_id", "label", "dim", "codes", "error"] and book_digest(books[1]) == hashlib.sha256(b"512,0,0,0").hexdigest()


def spectrum(values, seed=0):
    """A symmetric matrix of extended precision with about these eigenvalues."""
    n = len(values)
    q = np.linalg.qr(np.random.RandomState(seed).standard_normal((n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    return q @ np.diag(np.array(values, np.longdouble)) @ q.T


@pytest.mark.parametrize(
    "values",
    [[5, 4, 3, 2, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5], [2, 2, 2, 1, 1], [1, 1 + 1e-13, 1 + 2e-13, 1 + 1e-7, 3], [7, 0, 0], [1e9, 1, 1 + 1e-12, 1e-3], [0, 0], list(1 + 1e-8 * np.arange(40))],
)
def test_refined_eigenvectors(values):
    a = spectrum(values)
    a = (a + a.T) / 2
    value, x = refined_eigen(a)
    top = max(values) or 1
    assert np.abs(value - np.sort(np.array(values, np.longdouble))[::-1]).max() <= 1e-16 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * value).max() < 1e-17 * top
    # single precision alone is far from that
    if len(values) == 40:
        single = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
        assert np.abs(single.T @ a @ single - np.diag(np.diag(single.T @ a @ single))).max() > 1e-9


def test_whitening_against_plain(spark):
    rng = np.random.RandomState(1)
    v = (rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) + 3).astype(np.float32)
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    out = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = {(r["vec_id"], r["component"]): r for r in whitened(out).collect()}
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = x - s / n
    value, vector = np.linalg.eigh(z.T @ z / n)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 400 * 5
    for k in range(5):
        want = z @ vector[:, k] / np.sqrt(value[k])
        mine = np.array([got[i, k + 1]["whitened"] for i in range(n)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert got[0, k + 1]["explained"] == pytest.approx(value[k] / value.sum(), rel=1e-9)
    for i in (0, 17, 399):
        assert got[i, 1]["deviation"] == sum((n * int(a) - int(t)) ** 2 for a, t in zip(x[i], s, strict=True)) and got[i, 1]["n"] == n
    assert {r["identity_error"] for r in got.values()} == {got[0, 1]["identity_error"]} and got[0, 1]["identity_error"] < 1e-12


def test_whitening_of_nearly_equal_variances(spark):
    """Directions of nearly equal variance far from the origin, on which single precision fails."""
    rng = np.random.RandomState(5)
    v = np.linalg.qr(rng.standard_normal((600, 40)))[0] * 4000 + 9e4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = whitened(df).collect()
    assert len(out) == 600 * 32 and out[0]["identity_error"] < 1e-9
    w = np.zeros((600, 32))
    for r in out:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs((w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / 600 - np.eye(32)).max() < 1e-9


def test_whitening_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [7.0]), (8, [1e30, 0.0, 1.0]), (9, [-1e30, 0.0, 2.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 6), round(r["explained"], 6), round(r["identity_error"], 6)) for r in whitened(df).collect()), key=str)
    assert [g for g in got if g[2] == 3] == [(0, 1, 3, 256**2, 1.414214, 1.0, 0.0), (0, 2, 3, 256**2, 0.0, 0.0, 0.0)] + [(1, 1, 3, 128**2, 0.707107, 1.0, 0.0)] * 2 + [(1, 2, 3, 128**2, 0.0, 0.0, 0.0)] * 2
    assert [g for g in got if g[2] == 1] == [(6, 1, 1, 0, 0.0, 0.0, 0.0)]
    assert [g[:5] for g in got if g[2] == 2 and g[1] == 1] == [(8, 1, 2, (1 << 62) + 64**2, 1.0), (9, 1, 2, (1 << 62) + 64**2, 1.0)]
    assert whitened(df.limit(0)).count() == 0


def test_exact_covariance_of_large_values():
    x = np.array([[1 << 30, 1], [-(1 << 30), 2], [5, 3]], object)
    sums = x.sum(axis=0).tolist()
    middle = [(2 * s + 3) // 6 for s in sums]
    fit = Fit(3, sums, middle, (x - np.array(middle, object)).T @ (x - np.array(middle, object)), 2)
    want = sum((3 * a - sums[0]) * (3 * b - sums[1]) for a, b in x.tolist())
    assert float(fit.covariance[0, 1]) == pytest.approx(want / 27, rel=1e-15)
    assert fit.deviation(x.astype(np.int64))[2] == (15 - sums[0]) ** 2 + (9 - sums[1]) ** 2


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def plain_rule(url, rules):
    """(host, path, rule, action) by the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host, cut = rest, len(rest)
    for mark in "/?#":
        cut = min(cut, rest.find(mark) if mark in rest else cut)
    host, path = rest[:cut], rest[cut:]
    for mark in "?#":
        path = path.split(mark)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r, a) for a, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://net/", "http://a.NET", "https://x.example.net/en/1?q#f", "https://x.example.net/de/1", "http://example.com/de/x", "http://www.Example.COM/de", "http://example.com/de/", "http://org/fr/a",
    "http://b.org/fr/a", "http://borg/fr/a", "http://xnet/", "http://a.net.example.org/", "x://y://z.net/", "http://u@x.net:80/p", "http://x.net?/fr/", "http:///en/", "http://ünet/", "http://a.net\n/x", "ftp://é.example.net/en/", "http://..net/", "http://" + "a." * 3000 + "net/en/",
]


def test_rules_against_plain(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    more = [*RULES, *(("block", f"host{i}.test/{'x' * (i % 5)}") for i in range(200)), ("allow", "net/"), ("block", "z.net/")]
    for rules, chain in ((RULES, 64), (RULES, 0), (more, 64), (more, 1000)):
        known = {r: "allow" if ("allow", r) in rules else "block" for _, r in rules}
        got = {(r["page_id"], r["host"], r["path"], r["rule"], r["action"]) for r in with_rules(df, rules, chain).collect()}
        assert got == {(i, *plain_rule(u, [(a, r) for r, a in known.items()])) for i, u in enumerate(URLS * 2)}
    joined = {tuple(r) for r in with_rules(df, more, 0, broadcast=0).select("page_id", "rule").collect()}
    assert joined == {tuple(r) for r in with_rules(df, more, 1000).select("page_id", "rule").collect()}
    with pytest.raises(ValueError):
        with_rules(df, [("drop", "x/")])


def test_links_of_pages():
    found = link_targets(
        "http://a.test/dir/p?q",
        """<!-- <link rel=canonical href=/no> --><script>"<link rel=canonical href=/no>"</script><base href="/base/"><base href="/other/">
        <LINK REL="alternate Canonical" href=" c1 "><link href='//b.test/x?a=1&amp;b=2' rel='canonical'><link rel=canonical><link rel=stylesheet href=s>
        <meta http-equiv=Refresh content="0;URL='r1'"><meta http-equiv=refresh content="5"><meta content='3, http://c.test/' http-equiv='refresh'><link rel=canonical href="http://[bad">
        <linker rel=canonical href=/no><title><link rel=canonical href=/no></title><link rel="canonical" href="open""",
    )
    assert found == ["http://a.test/base/c1", "http://b.test/x?a=1&b=2", "http://a.test/base/r1", "http://c.test/", "http://a.test/base/open"]
    assert link_targets("http://a.test/", '<link "' * 50_000) == []


def test_aliases_against_plain(spark):
    canonical = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
    pages = [
        (1, "http://p.test/1", canonical("http://q.net/x")),  # an alias of a URL that only the link names
        (2, "http://p.test/2#f", canonical("/1")),
        (3, "http://P.test/3", canonical("http://x.example.net/en/a")),  # an allow does not travel, and it blocks nothing
        (4, "http://x.example.net/en/b", canonical("http://p.test/1")),  # allowed itself, and joined to a blocked class
        (5, "http://p.test/5", '<meta http-equiv="refresh" content="0; url=http://x.example.net/en/b#z">'),
        (6, "http://p.test/6", canonical("http://p.test/6")),
        (7, None, canonical("http://q.net/x")),
        (8, "http://p.test/8", None),
        (9, "http://p.test/2", ""),
        (9, "http://p.test/2", ""),
        (None, "http://p.test/2?other", ""),
        (20, "http://chain.test", canonical("http://chain.test/0")),
        *((100 + i, f"http://chain.test/{i}", canonical(f"http://chain.test/{i + 1}")) for i in range(60)),
        (30, "http://chain.test/60", '<meta http-equiv=refresh content="0;http://b.example.com/de/end">'),
        *((200 + i, f"http://free.test/{i}", canonical("http://free.test/hub")) for i in range(40)),
    ]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))

    def key(u):
        head, rest = u.split("#")[0].split("://", 1)
        host, slash, tail = rest.partition("/")
        return f"{head}://{host.lower()}/{tail}"

    links, urls = defaultdict(set), {}
    for _, u, h in pages:
        for t in link_targets(u, h) if u and h else ():
            urls[key(u)], urls[key(t)] = u, t
            links[key(u)].add(key(t))
            links[key(t)].add(key(u))
    blocked = set()
    for start, u in urls.items():
        if plain_rule(u, RULES)[3] == "block":
            todo = [start]
            while todo:
                at = todo.pop()
                if at not in blocked:
                    blocked.add(at)
                    todo.extend(links[at])
    want = []
    for i, u, _ in pages:
        host, path, rule, action = plain_rule(u, RULES)
        want.append((i, host, path, rule, action or ("block" if u and key(u) in blocked else "allow")))
    got = [tuple(r)[:5] for r in judge_urls(df, RULES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    verdict = {r["page_id"]: (r["verdict"], r["alias_rule"]) for r in judge_urls(df, RULES).collect()}
    assert verdict[2] == verdict[5] == ("block", "net/") and verdict[4] == ("allow", None) and verdict[3] == ("allow", None) and verdict[20] == ("block", "example.com/de/") and verdict[239] == ("allow", None)
    more = spark.createDataFrame([("http://free.test/hub", "http://q.net/"), (None, "http://q.net/"), ("http://free.test/1", None)], "source string, target string")
    assert {r["verdict"] for r in judge_urls(df, RULES, more).filter("page_id BETWEEN 200 AND 239").collect()} == {"block"}
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert judge_urls(df, ()).filter("verdict <> 'allow'").count() == 0
