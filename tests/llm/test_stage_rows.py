"""The functions that return rows of documents: clashing names, repeated and null ids, equal rows, empty tables."""

import random
import re

import numpy as np
import pytest

from fieldspark.llm import decontaminate, exact_dedup, fuzzy_lines, mixing, quality, secrets, simhash

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrst") for _ in range(RNG.randint(2, 8))) for _ in range(300)]
CLASHING = "th row id hash _keep _sha _copies _gone _quality_score _bad _text n kept score component component_id domain first gone copies spans base markov u k".split()
KEY = "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def wide(spark, rows):
    """(doc_id, text, lang) and columns of clashing names, each with the number of the row."""
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", *[str(n)] * len(CLASHING)) for n, (i, t) in enumerate(rows)], schema)


A, B, C, D, ITEM = prose(60), prose(60), prose(60), prose(60), prose(20)
ROWS = [
    (3, A), (3, B), (None, C), (None, D), (7, A.replace(" ", "  ", 1)), (8, B), (9, B), (9, B), (10, "words before " + ITEM + " after"), (10, prose(40)),
    (11, None), (12, ""), (13, f"a key {KEY} token=abcdef12 here"), (14, A + "\nprecious line " + prose(9)), (14, A + "\nanother precious line " + prose(9)), (15, "#$ " * 40),
]


def labels_of(spark):
    rows = [(i, int(i != 15), 0) for i, _ in ROWS if i is not None]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark_of(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (None, "x y")], "item_id long, text string")


FUNCTIONS = {
    "keep_good": lambda s, d: quality.keep_good(d, labels_of(s)),
    "near_dedup": lambda s, d: simhash.near_dedup(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark_of(s)),
    "mix": lambda s, d: mixing.mix(d, labels_of(s)),
    "dedup_lines": lambda s, d: fuzzy_lines.dedup_lines(d),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "mask_secrets": lambda s, d: secrets.mask_secrets(d),
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_rows(spark, name):
    docs = wide(spark, ROWS)
    out = FUNCTIONS[name](spark, docs)
    assert out.columns == docs.columns
    got = [(int(r.th), r.doc_id, r.text) for r in out.collect()]
    assert all(ROWS[n][0] == i for n, i, _ in got)  # columns stay with their rows
    kept, texts = sorted(n for n, _, _ in got), {n: t for n, _, t in got}
    if name not in ("dedup_lines", "mask_secrets"):
        assert all(ROWS[n][1] == t for n, _, t in got)
    if name == "exact_dedup":
        assert set(kept) - {6, 7} == {0, 1, 2, 3, 8, 9, 10, 12, 13, 14, 15} and len(kept) == 11
    elif name == "decontaminate":
        assert kept == [n for n in range(len(ROWS)) if n != 8]
    elif name == "near_dedup":
        assert {0, 1, 2, 3, 8, 9, 10, 15} <= set(kept) and not {4, 5, 6, 7, 11} & set(kept) and len(kept) == len(set(kept))
    elif name == "dedup_lines":
        assert len(kept) == len(ROWS) and texts[13].startswith("precious line") and texts[14].startswith("another precious line")
        assert texts[0] == A and texts[1] == B and texts[4] == "" and texts[10] is None and texts[11] == ""
    elif name == "mask_secrets":
        assert len(kept) == len(ROWS) and texts[12] == "a key <secret> <secret> here" and texts[10] is None
        assert all(texts[n] == ROWS[n][1] for n in range(len(ROWS)) if n != 12)
    elif name == "mix":
        assert set(kept) <= set(range(len(ROWS))) and kept
    else:
        assert {0, 1, 8} <= set(kept) and len(kept) == len(set(kept))


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_empty(spark, name):
    docs = wide(spark, ROWS).limit(0)
    out = FUNCTIONS[name](spark, docs)
    assert out.columns == docs.columns and out.count() == 0


def test_votes_against_brute_force(spark):
    """Scores are the cosine-weighted votes of the nearest labelled vectors, computed here one pair at a time."""
    rng = random.Random(3)
    docs = [(i, prose(50) if i % 2 else "$$ " * rng.randint(20, 50) + prose(3)) for i in range(120)] + [(500, docs_text) for docs_text in ("", "x")] + [(501, "long " * 300_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    table = wide(spark, docs).select("doc_id", "text")
    model = quality.fit(table, labels, 64)
    texts = [t for _, t in docs]
    raws = [t.encode() for t in texts]
    z = quality.vectors(np.stack([quality.term_counts(r) for r in raws]), np.stack([quality.shape_terms(t, r) for t, r in zip(texts, raws)]), model.idf) @ model.basis
    want = []
    for v in z.astype(float):
        cos = [float(v @ w) / max(float(np.linalg.norm(v)) * float(np.linalg.norm(w)), 1e-12) for w in model.labelled.astype(float)]
        last = sorted(cos)[-min(quality.NEIGHBOURS, len(cos))]
        near = [(max(c, 1e-3) ** quality.POWER, y) for c, y in zip(cos, model.labels) if c >= last - 1e-7]
        want.append(sum(w * y for w, y in near) / sum(w for w, _ in near))
    assert len(model.labels) <= 64
    assert np.allclose(model.score(texts), np.clip(want, 0, 1), atol=2e-3)


def least_squares(a, t):
    """Nonnegative least squares by active sets (Lawson and Hanson), in numpy."""
    n, x, free = a.shape[1], np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        g = a.T @ (t - a @ x)
        if free.all() or g[~free].max() < 1e-12:
            return x
        free[np.flatnonzero(~free)[g[~free].argmax()]] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], t, rcond=None)[0]
            if s[free].min() > 0:
                break
            bad = free & (s <= 0)
            x += (x[bad] / (x[bad] - s[bad])).min() * (s - x)
            free &= x > 1e-14
        x = s


@pytest.mark.parametrize("targets", [[0.2, 0.3, 0.5], [0.9, 0.05, 0.05], [1.0, 0.0, 0.0]])
def test_rates_against_the_optimum(spark, targets):
    """The residual of the fitted rates is that of the nonnegative least squares optimum, reachable (zero) or not."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet([3.0, 3.0, 3.0], 60)
    n = rng.integers(1, 200, 60)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>").coalesce(1).cache()
    a = (p * (n / n.sum())[:, None]).T
    best = np.linalg.norm(a @ least_squares(a, np.array(targets)) - targets)
    r = np.array([x.r for x in mixing.fit_rates(members, targets).select("r").collect()])
    assert (r >= 0).all() and np.linalg.norm(a @ r - targets) <= 1.01 * best + 2e-5


def test_unsettled_rates_raise(spark):
    members = spark.createDataFrame([(5, [0.6, 0.4]), (5, [0.5, 0.5]), (9, [0.3, 0.7])], "n_tokens long, p array<double>")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.fit_rates(members, [1.0, 0.0], steps=2)


def test_mixture_against_brute_force(spark):
    """Posteriors of the multinomial classifier, rates and copies, from the texts in plain Python."""
    rng = random.Random(3)
    vocab = {k: [f"{k}{j}" for j in range(30)] + ["both", "all"] for k in "xyz"}
    rows = [(i, " ".join(rng.choice(vocab["xyz"[i % 3]]) for _ in range(rng.randint(1, 40))), "xyz"[i % 3]) for i in range(90)] + [(200, None, "x"), (201, "", "y"), (202, "both all never seen", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 90, 2)], "doc_id long, quality int")
    taught, names = [r for r in rows[:90:2]], sorted("xyz")
    counts = {k: {} for k in names}
    for _, t, k in taught:
        for w in t.lower().split():
            counts[k][w] = counts[k].get(w, 0) + 1
    v = len({w for c in counts.values() for w in c})
    p, n = [], []
    for _, t, _ in rows:
        words = (t or "").lower().split()
        known = [w for w in words if any(w in c for c in counts.values())]
        z = [np.log(sum(k == x for _, _, x in taught) / len(taught)) + min(1, 4 / max(1, len(words))) * sum(np.log(counts[k].get(w, 0) + 1) - np.log(sum(counts[k].values()) + v) for w in known) for k in names]
        e = np.exp(np.array(z) - max(z))
        p.append(e / e.sum())
        n.append(len(words))
    p, n = np.array(p), np.array(n)
    got = sorted(mixing.mixture(docs, labels, weights={"x": 2, "y": 1, "z": 1}).collect())
    assert np.allclose([r.posterior for r in got], p, atol=2e-6) and [r.n_tokens for r in got] == n.tolist()
    rate = np.array([r.rate for r in got])
    assert np.abs((p * (n * rate)[:, None]).sum(0) / n.sum() - [0.5, 0.25, 0.25]).max() < 1e-4 and all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_markov_parts(spark):
    """Random parts of a run beside a base span are reported, and a lone key in a table of three short documents is."""
    rng = random.Random(12)
    a, b = ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz0123456789") for _ in range(31)) + "z" for _ in "ab")
    b = "z" + b
    rows = [(1, f"é {a}{'0123456789ab' * 2}{b} end"), (2, f"key {KEY} it is"), (3, None)]
    got = {r.doc_id: r for r in secrets.secret_spans(wide(spark, rows)).collect()}
    assert got[1].spans == f"markov:2:34,hex:34:58,markov:58:{58 + len(b)}" and (got[1].n_hex, got[1].n_markov) == (1, 2)
    assert got[2].spans == "markov:4:36" and got[3].spans == ""
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(wide(spark, rows)).collect()}
    assert masked[1] == "é <secret><secret><secret> end" and masked[2] == "key <secret> it is"
    assert secrets.secret_spans(wide(spark, rows[1:2] * 3)).where("n_markov = 1").count() == 3  # repeated rows


def test_secret_precision_and_recall(spark):
    """Held-out random strings are found, held-out identifiers and UUIDs are not."""
    rng = random.Random(31)
    alphabets = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "lower36": "abcdefghijklmnopqrstuvwxyz0123456789"}
    random_ = ["x" + "".join(rng.choice(a) for _ in range(rng.randint(22, 40))) for a in alphabets.values() for _ in range(60)]
    parts = "get set user name connection factory builder request handler list cache buffer stream table column order total price shipping address config value default parser index".split()
    plain = []
    for _ in range(180):
        w = [rng.choice(parts) for _ in range(rng.randint(4, 6))]
        plain.append(rng.choice(["_".join(w), w[0] + "".join(x.title() for x in w[1:]), "-".join(w), "/".join(w)]))
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    plain += [f"{hexa[:8]}-{hexa[8:12]}-{hexa[12:16]}-{hexa[16:20]}-{hexa[20:]}"]
    lore = [(5000 + k, " ".join(rng.choice(parts + WORDS) for _ in range(200))) for k in range(300)]
    rows = [(i, f"see {t} now") for i, t in enumerate(random_ + plain)]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(wide(spark, rows + lore)).collect()}
    found = [bool(re.search("markov", got[i])) for i in range(len(rows))]
    assert sum(found[: len(random_)]) >= 0.95 * len(random_)
    assert sum(found[len(random_) :]) <= 0.05 * len(plain) and not found[-1]
