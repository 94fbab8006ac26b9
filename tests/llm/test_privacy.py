import hashlib
import re

import numpy as np

from tallyforge.llm import privacy
from tests.llm.helpers import docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in s) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def check(spark, texts):
    got = {r.doc_id: r for r in privacy.digest(privacy.find(docs(spark, list(enumerate(texts))))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t or "")
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[3] == k for w in want) for k in PLAIN], (t, got[i])
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, said, got[i].spans)
        assert said == ",".join(s for s in got[i].spans.split(",") if not s.startswith("term:"))


def test_base_spans_match_plain_patterns(spark):
    r = np.random.default_rng(3)
    bits = ["a", "b.c", "@", ".", "-", "+1", " ", "4111 1111 1111 1111", "5", "255", "1.2.3.4", "x@y.zz", "(", ")", "é", "😀", "_", "%", "10.0.0.256", "+49 (30) 123-4567", "\n", "0", "4785380592391139", "..", "ex.com"]
    texts = ["".join(r.choice(bits, r.integers(1, 25))) for _ in range(600)]
    texts += [None, "", "a@b.com@c.org", "a@b.com_x@c.org", "1.2.3.4.5.6.7.8", "01.002.3.4", "000000300.1.1.1", "+1234567890123456"]
    check(spark, texts)


def test_long_runs_end(spark):
    check(spark, ["a" * 100_000, "0" * 100_000, "1." * 50_000, "a@" + "b." * 20_000 + "c", "+" + "1 " * 30_000, ("x@y.zz " * 800)])


def test_words_that_disclose(spark):
    near = [(i, f"filler{i} words about zorblax agent reach zorblax@corp.com quickly number{i}") for i in range(8)]
    far = [(100 + i, f"plain text {i} about quickly agent words and reach") for i in range(200)]
    found = {r.doc_id: r for r in privacy.digest(privacy.find(docs(spark, near + far))).collect()}
    text = dict(near)[3]
    at = text.index("zorblax")
    assert f"term:{at}:{at + 7}" in found[3].spans and "agent" not in found[3].spans
    assert all(found[i].spans == "" for i, _ in far)
    clean = {r.doc_id: r for r in privacy.sanitise(docs(spark, near + far + [(500, None)])).collect()}
    assert clean[3].text == "filler3 words about  agent reach [EMAIL] quickly number3" and clean[3].n_chars == len(clean[3].text)
    assert clean[100].text == far[0][1] and clean[500].text is None


def telling(texts):
    """Telling words by the definition: every pair of a word and an entity of a document, counted one by one."""
    texts = [t or "" for t in texts]
    held = []
    for t in texts:
        spans = brute(t)
        outside, at = "", 0
        for a, _, b, _ in spans:
            outside += t[at : max(at, a)] + (" " if a >= at else "")
            at = max(at, b)
        outside += t[at:]
        words = lambda x: {w for w in re.split(r"[\W_]+", x.lower()) if len(w) >= 3}
        held.append(({(k, t[a:b].lower()) for a, k, b, _ in spans}, words(outside), words(t)))
    out = {}
    for e in {e for es, _, _ in held for e in es}:
        of = [k for k, (es, _, _) in enumerate(held) if e in es]
        if len({texts[k] for k in of}) < 3 or len(of) == len(texts):
            continue
        own = -np.log2(len(of) / len(texts))
        for w in {w for k in of for w in held[k][1]}:
            both = [k for k in of if w in held[k][1]]
            if len({texts[k] for k in both}) < 3:
                continue
            with_term = sum(w in every for _, _, every in held)
            share = (np.log2(len(both) / with_term) + own) / own
            if share >= 0.9 - 1e-12:
                out[w] = max(out.get(w, 0), share)
    return out


def test_disclosure_is_that_of_all_pairs(spark):
    r = np.random.default_rng(17)
    texts = []
    for k in range(400):
        words = [f"w{x}" for x in (r.zipf(1.4, 12) % 300)]
        if k % 4 == 0:
            g = int(r.integers(0, 12))
            words += [f"user{g}@ex.org", *(f"tell{g}x{j}" for j in range(3) if r.random() < 0.8)]
            if k % 3 == 0:
                words += [f"10.0.0.{g}", "+49 30 1234567"]
        elif r.random() < 0.05:
            words.append(f"tell{r.integers(0, 12)}x0")
        r.shuffle(words)
        texts.append(" ".join(words))
    texts += texts[:20] + [None, "", "user1@ex.org"] + ["tell2x1 user2@ex.org same"] * 6
    want = telling(texts)
    got = {}
    for row in privacy.find(docs(spark, list(enumerate(texts)))).collect():
        for s in row.spans:
            if s.kind == len(privacy.KINDS):
                got[texts[row.doc_id][s.start : s.end].lower()] = s.remove
    assert len(want) > 20 and set(got) == set(want)
    assert all(got[w] == (share >= privacy.REMOVE) for w, share in want.items() if abs(share - privacy.REMOVE) > 1e-9)


def test_many_matches_end_soon(spark):
    import time

    text = "\n".join(f"line{k} user{k}@ex{k % 7}.org and 10.0.{k % 256}.{k % 200}" for k in range(8_000))
    rows = [(k, text + f"\nlast{k}") for k in range(4)]
    began = time.time()
    clean = {x.doc_id: x.text for x in privacy.sanitise(docs(spark, rows + [(10 + k, "line5 and so on") for k in range(200)])).collect()}
    assert time.time() - began < 90
    assert clean[0].count("[EMAIL]") == 8_000 and clean[0].count("[IP]") == 8_000 and "@" not in clean[0]
    assert clean[10] == "line5 and so on"


def test_empty_and_repeated(spark):
    assert privacy.digest(privacy.find(docs(spark, []))).collect() == []
    rows = [(1, "x a@b.cc"), (1, "x a@b.cc"), (None, "+49 30 1234567")]
    assert sorted(r.n_email for r in privacy.digest(privacy.find(docs(spark, rows))).collect()) == [0, 1, 1]
    assert privacy.sanitise(docs(spark, rows)).count() == 3


def test_a_telling_word_is_marked_wherever_it_stands(spark):
    near = [(i, f"Zorblax heads item{i}, then come so many other words that no reach spans them: agent Zorblax zorblax@corp.com ends {i}") for i in range(8)]
    other = [(50, "a letter of ZORBLAX\u0130, and of zorblaxes: \u0130\U0001f600 Zorblax."), (51, "nothing of it")]
    far = [(100 + i, f"plain text {i} heads agent ends then come so many other words that no reach spans them") for i in range(400)]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs(spark, near + other + far)).collect()}
    assert clean[3] == "[TERM] heads item3, then come so many other words that no reach spans them: agent [TERM] [EMAIL] ends 3"
    assert clean[50] == "a letter of ZORBLAX\u0130, and of zorblaxes: \u0130\U0001f600 [TERM]." and clean[51] == "nothing of it"
    assert all(clean[i] == t for i, t in far)


def test_planted_entities_in_thousands_of_documents(spark):
    """40 shared entities among 4,000 documents, two code words each: which words are marked, and which wrongly."""
    r = np.random.default_rng(11)
    common = ["w" + "".join(r.choice(list("abcdefghij"), 4)) for _ in range(3000)]
    texts = [list(r.choice(common, int(r.integers(20, 90)))) for _ in range(4000)]
    codes = {}
    for e in range(40):
        at = r.choice(4000, 8, replace=False)
        for k, doc in enumerate(at):
            if k < 6:  # two more have the code words alone
                texts[doc].insert(int(r.integers(len(texts[doc]))), f"person{e}@corp{e % 3}.org")
            for word in (f"code{e}x", f"alias{e}q"):
                texts[doc].insert(int(r.integers(len(texts[doc]))), word)
                codes.setdefault(doc, set()).add(word)
    texts = [" ".join(t) for t in texts]
    got = {x.doc_id: x for x in privacy.digest(privacy.find(docs(spark, list(enumerate(texts))))).collect()}
    marked = {(d, texts[d][int(a) : int(b)]) for d, x in got.items() for kind, a, b in (s.split(":") for s in x.spans.split(",") if s) if kind == "term"}
    planted = {(d, w) for d, ws in codes.items() for w in ws}
    assert len(planted & marked) / len(planted) > 0.98
    assert len(marked - planted) / len(planted) < 0.02
    assert sum(x.n_email for x in got.values()) == 240
