import re

import numpy as np

from tallyforge.llm import components, probminhash
from tests.llm.helpers import docs


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [(i, t or "", sets(t or "")) for i, t in rows]
    for i, t, a in s:
        for j, u, b in s:
            if i < j and (t == u or a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in rows}


def corpus(r):
    word = lambda n: [f"w{x}" for x in r.integers(0, 5000, n)]
    rows, n = [], 0
    for size in (8, 40, 150, 150, 400):
        base = word(size)
        for _ in range(25):
            t = list(base)
            for k in r.integers(0, size, r.integers(0, max(2, size // 25))):
                t[k] = f"e{r.integers(0, 10**6)}"
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n + k, " ".join(word(60))) for k in range(60)]
    return rows + [(900, "a b"), (901, "A  b"), (902, ""), (903, None), (904, rows[30][1]), (905, ("line of five words here\n" * 50)), (906, ("line of five words here\n" * 60))]


def test_classes_match_all_pairs(spark):
    rows = corpus(np.random.default_rng(5))
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in probminhash.classes(docs(spark, rows)).collect()}
    assert got == want
    kept = {r.doc_id for r in probminhash.one_of_each(docs(spark, rows)).collect()}
    assert kept == set(want.values())


def test_slots_estimate_probability_jaccard():
    a, b = {k: 1.0 + k % 3 for k in range(60)}, {k: 1.0 + k % 2 for k in range(20, 80)}
    want = 0.0
    for i in set(a) & set(b):
        want += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b))
    out = []
    for salt in range(30):
        sig = [probminhash.signatures(np.zeros(len(x), np.int64), np.array([k * 7919 + salt * 10**9 + 1 for k in x], np.uint64), np.array(list(x.values())), 1)[0] for x in (a, b)]
        out.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(out) - want) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150, 300: 150}


def test_lines_repeated_unequally_link(spark):
    r = np.random.default_rng(8)
    line, rows = " ".join(f"line{k}" for k in range(12)), []
    for pair in range(12):  # small buckets: alike as sets, far apart by how often the line stands there
        base = " ".join(f"w{x}" for x in r.integers(0, 10**6, 300))
        rows += [(2 * pair, f"{base} {line}"), (2 * pair + 1, base + f" {line}" * 50)]
    base = " ".join(f"v{x}" for x in r.integers(0, 10**6, 300))
    rows += [(100 + k, " ".join([f"u{k}", base, *[line] * (1 + 3 * k)])) for k in range(30)]  # a large one
    got = {x.doc_id: x.class_id for x in probminhash.classes(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_bucket_loses_no_link(spark):
    """Thousands of altered copies, many of them in no link with the original but with one another."""
    r = np.random.default_rng(21)
    base = [f"b{x}" for x in r.integers(0, 10**6, 220)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1500):
        t = list(base)
        for p in r.choice(220, int(r.integers(0, 12)), replace=False):
            t[p] = f"n{r.integers(0, 10**9)}"
        rows.append((k, " ".join(t)))
    got = {x.doc_id: x.class_id for x in probminhash.classes(docs(spark, rows)).collect()}
    codes: dict = {}
    own = [np.unique([codes.setdefault(g, len(codes)) for g in sets(t)]) for _, t in rows]
    flags = np.zeros((len(rows), len(codes)), np.float32)
    for k, s in enumerate(own):
        flags[k, s] = 1
    common = flags @ flags.T
    size = np.array([len(s) for s in own])
    near = common >= 0.8 * (size[:, None] + size[None, :] - common)
    assert (~near[0]).sum() > 100  # not all are linked with the original
    lost = [(i, j) for i, j in np.argwhere(near) if got[i] != got[j]]
    assert not lost
    first = np.arange(len(rows))  # and nothing else is connected
    while True:
        after = np.where(near, first[None, :], len(rows)).min(axis=1)
        if (after == first).all():
            break
        first = after
    assert [got[k] for k in range(len(rows))] == first.tolist()


def test_very_long_text(spark):
    r = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in r.integers(0, 10**6, 200_000))
    rows = [(1, long), (2, long + " more"), (3, "short text of a few words"), (4, long[: len(long) // 2])]
    got = {x.doc_id: x.class_id for x in probminhash.classes(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
