"""Conversation trie, URL filter and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fieldspark.llm import periodic_runs, prefix_trie, url_filter

RNG = random.Random(33)


# Conversation trie


def conversations_of(spark, rows):
    """Rows (conv_id, turn, role, text) with columns whose names clash with those the operator uses."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, k long, t long")


def random_rows(n, depth, words, rng):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, depth)):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(words)))
    return rows


def turns_of(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def rebuild(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute_trie(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        ends = sorted(c for c in m if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(3, 6, 4), (7, 1000, 5), (65_536, 1 << 20, 4096)])
def test_trie(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = random_rows(60, 6, ["a", "b", None, "é", ""], rng) + [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)] + [(300, t, "u", str(t)) for t in range(70)]
    rows += [(400, None, "r", "null turn"), (400, 0, "r", "x"), (401, 1, "r", "tie"), (401, 1, "r", "tie"), (None, 1, "r", "no conversation"), (500, 0, None, None)]
    rows += [(1001 + i, 0, "u", "base absent") for i in range(4)]
    rng.shuffle(rows)
    turns = prefix_trie.rebuilt(prefix_trie.sequences(conversations_of(spark, rows)))
    built = rebuild(turns_of(rows))
    assert any(not t for t in built.values())  # turnless ones end at the root
    got = [tuple(r) for r in prefix_trie.prefix_trie(turns, *sizes).collect()]
    assert sorted(got, key=str) == brute_trie(built)


def test_trie_plain_and_empty(spark):
    rows = [(5, 0, "a", "x"), (5, 1, "b", "y"), (9, 0, "a", "x")]
    got = prefix_trie.prefix_trie(prefix_trie.sequences(conversations_of(spark, rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(turns_of(rows))
    for none in ([], [(None, 1, "a", "b")]):
        assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(conversations_of(spark, none)))).count() == 0


def test_role_and_text_keep_apart(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, None, "abc")]
    got = prefix_trie.prefix_trie(prefix_trie.sequences(conversations_of(spark, rows))).where("depth = 1").collect()
    assert sorted(r.n_convs for r in got) == [1, 1, 1]


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 500, 20_000])
def test_parentheses(n):
    rng = random.Random(n)
    bits, left, depth = [1], n - 1, 1
    while depth:  # one tree of n nodes
        up = left and (depth == 1 or rng.random() < (0.5 if n % 2 else 0.8))
        bits.append(int(bool(up)))
        left, depth = (left - 1, depth + 1) if up else (left, depth - 1)
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.flatnonzero(bits)
    got = prefix_trie.Parentheses(np.array(bits, bool)).find_close(opens)
    assert got.tolist() == [want[i] for i in opens.tolist()]


# URL filter


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1.0, "y") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, score double, rule string")


URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1?q#f", "http://example.net", "http://b.example.com/de/1", "http://b.example.com/en/1#/de/", "http://x.org/fr/2", "http://org/fr/", "http://notorg/fr/2", "ftp://c.org?x=/fr/",
    None, "", "no scheme/net/", "x://y://net/", "http://é.org/fr/ü", "http://a.b.net/\nline", "://d.net/", "http://u:p@e.net:80/x", "http://" + "long." * 2000 + "net/" + "z" * 100_000, "HTTP://A.NET/x",
]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    best = None
    for action, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return best


def test_rules(spark):
    got = {r.page_id: r for r in url_filter.filter_urls(pages_of(spark, [(u, None) for u in URLS])).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        rule = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1])
        assert got[i].verdict == rule[0] if rule else got[i].verdict in ("allow", "block")


def test_scores(spark):
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "good.org", "sub.h1.com"]
    links = {h: [RNG.choice(hosts) for _ in range(RNG.randint(0, 5))] for h in hosts}
    links["h3.com"] += ["bad.net"] * 40
    rows = []
    for h in hosts:
        html = " ".join(f"<A class=x HREF='http://{t.upper()}/p?q'>t</a>" if k % 2 else f'<a href="//{t}#f">' for k, t in enumerate(links[h])) + '<a href="/own"><a href="mailto:x@y">'
        rows.append((f"http://{h}{'/fr/1' if h == 'good.org' else '/en/1'}", html))
        rows.append((f"http://{h}/other", None))
    rows.append(("http://h5.com/x", '<a href="http://elsewhere.com/">'))
    got = url_filter.filter_urls(pages_of(spark, rows), tolerance=1e-9, max_steps=200).collect()
    names = [*hosts, "elsewhere.com"]
    at = {h: i for i, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for h in hosts:
        for t in links[h]:
            if t != h:
                w[at[h], at[t]] += 1
    w[at["h5.com"], at["elsewhere.com"]] += 1
    w[at["sub.h1.com"], at["h1.com"]] += 1
    w[at["h1.com"], at["sub.h1.com"]] += 1
    trust, distrust = np.zeros(len(names)), np.zeros(len(names))
    trust[at["good.org"]], distrust[at["bad.net"]] = 0.5, 1.0
    ahead, back = w / np.maximum(w.sum(1, keepdims=True), 1), w / np.maximum(w.sum(0, keepdims=True), 1)
    t = np.linalg.solve(np.eye(len(names)) - 0.85 * ahead.T, trust)
    d = np.linalg.solve(np.eye(len(names)) - 0.85 * back, distrust)
    for r in got:
        assert abs(r.score - (t - d)[at[r.host]]) < 1e-6
        if r.rule is None:
            assert r.verdict == ("block" if (d - t)[at[r.host]] >= 0.5 else "allow")
    assert {r.verdict for r in got if r.host == "h3.com"} == {"block"}  # it links to a blocked host above all


def test_filter_odd_tables(spark):
    assert url_filter.filter_urls(pages_of(spark, [])).count() == 0
    assert [r.verdict for r in url_filter.filter_urls(pages_of(spark, [(None, None)] * 2)).collect()] == ["allow"] * 2
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages_of(spark, []), [("drop", "net", "/")])
    with pytest.warns(RuntimeWarning):
        ring = [("http://a.net/", '<a href="http://b.com/">'), ("http://b.com/", '<a href="http://a.net/">'), ("http://c.org/fr/", '<a href="http://a.net/">')]
        url_filter.filter_urls(pages_of(spark, ring), tolerance=1e-12, max_steps=4)


# Periodic runs


def brute_runs(words, least=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(all(words[t] == words[t + d] for t in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def brute_report(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_run_report(spark):
    words = ["w%d" % i for i in range(40)] + ["é", "日本", "\u00a0x"]
    texts = [" ".join(RNG.choice(words) for _ in range(RNG.randint(1, 150))) for _ in range(60)]
    texts += ["a " * 30, "a b " * 12 + "c " + "a b " * 20, "x\ty\nz " * 9, None, "", " \n", "lone", "p q r s t u v w " * 3, "a " * 23, ("a a b " * 5 + "c ") * 4]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "m n " * 20)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs long, best string")
    got = [tuple(r) for r in periodic_runs.run_report(df).collect()]
    assert sorted(got, key=str) == sorted((brute_report(i, t) for i, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 5


@pytest.mark.parametrize("least,times", [(24, 3), (2, 2), (7, 3), (12, 4)])
def test_runs_small_alphabets(least, times):
    rng = random.Random(least)
    for _ in range(150):
        words = [str(rng.randrange(rng.choice([1, 2, 3]))) for _ in range(rng.randint(0, 90))]
        (n, runs, _, kept), (_, other, _, _) = periodic_runs._batch([" ".join(words), "z " + " ".join(words)], least, times)
        assert n == len(words) and runs == brute_runs(words, least, times) and other == brute_runs(["z", *words], least, times)


def test_long_run_and_empty(spark):
    text = "head " + "one two three " * 60_000
    df = spark.createDataFrame([(2, text)], "doc_id long, text string")
    r = periodic_runs.periodic_runs(df).first()
    assert [tuple(x) for x in r.runs] == [(1, 180_000, 3)] and r.collapsed == "head one two three" and r.n_words == 180_001
    assert periodic_runs.run_report(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, times=1)
