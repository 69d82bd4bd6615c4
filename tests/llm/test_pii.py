"""Personal data: the base against plain patterns, the CRF against enumeration, the tagger on held-out spans."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from hopweave.llm import pii

SF = "/root/testdata/sf0.001"


def plain(text):
    """The base as its contract words it."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, few, many in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if few <= len(d) <= many and (kind == "phone" or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_base_is_that_of_the_patterns():
    rng = random.Random(3)
    hits = 0
    for k in range(6000):
        t = "".join(rng.choices("a.@@1-+ 0(5é" if k % 2 else "0123456789.. -+", k=rng.randrange(0, 40)))
        if k % 5 == 0:
            t += pii._planted(rng)[0] + rng.choice([".", "", "@", ".5", " 4"])
        assert pii.base_spans(t) == plain(t), t
        hits += len(plain(t))
    assert hits > 500
    assert pii.base_spans("0255.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112") == plain("0255.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112")


def test_base_is_linear():
    for text in ("a" * 2_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "a@b." * 200_000):
        began = time.time()
        pii.base_spans(text)
        assert time.time() - began < 5


def test_sums_and_best_tags_are_those_of_all_sequences():
    rng = np.random.default_rng(0)
    m = pii.Tagger(hidden=4)
    m.p = {k: v.astype(np.float64) + (0.5 * rng.standard_normal(v.shape) if k in "aA" else 0) for k, v in m.p.items()}
    x = rng.integers(0, pii.CHARS, (4, 3))
    _, e = m.emissions(x)
    A, a = m.p["A"] + pii._BARRED, m.p["a"] + pii._NO_START
    fore, back, _, log = m._messages(e)
    tags, sure = m.decode(x.T)
    for n in range(3):
        scores = {y: a[y[0]] + sum(e[t, n, y[t]] for t in range(4)) + sum(A[y[t - 1], y[t]] for t in range(1, 4)) for y in itertools.product(range(pii.TAGS), repeat=4)}
        total = np.log(np.exp([*scores.values()]).sum())
        assert abs(total - log[n]) < 1e-6
        assert tuple(tags[n]) == max(scores, key=scores.get)
        for t in range(4):
            assert abs(sum(np.exp(s - total) for y, s in scores.items() if y[t] == tags[n, t]) - sure[n, t]) < 1e-6
    y = np.array([[0, 1, 2, 0], [3, 4, 4, 5], [0, 0, 7, 8]]).T
    loss, grads = m.loss(x, y)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in g.shape)
            at = (at[0], int(x[1, 0]), at[2]) if name == "X" else at
            old, ends = m.p[name][at], []
            for d in (1e-4, -1e-4):
                m.p[name][at] = old + d
                ends.append(m.loss(x, y)[0])
            m.p[name][at] = old
            assert abs((ends[0] - ends[1]) / 2e-4 - g[at]) < 1e-4, (name, at)


def test_choice_is_the_heaviest_set():
    rng = random.Random(5)
    for _ in range(200):
        found = [(s, s + rng.randrange(1, 8), rng.choice(pii.KINDS), rng.random()) for s in rng.choices(range(20), k=rng.randrange(0, 8))]
        best = max(sum(f[3] for f in some) for r in range(len(found) + 1) for some in itertools.combinations(found, r) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)))
        got = pii.chosen(found)
        assert abs(sum(f[3] for f in got) - best) < 1e-9 and got == sorted(got)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def model(docs):
    return pii.fit(docs)


FORMS = [
    ("email", "bob.smith [at] mail [dot] com"), ("email", "joe.doe(at)example.com"), ("email", "ann [at] uni.example"), ("phone", "(743) 555-3824"), ("phone", "743-555-3824"), ("phone", "0049 301 5551234"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("ip", "10[.]20[.]30[.]40"), ("ip", "2001:db8:85a3:1:2:8a2e:370:7334"),
]


def test_added_spans_on_held_out_texts(docs, model):
    texts = [r["text"] for r in docs.where("text is not null and length(text) between 200 and 5000").limit(60).collect()]
    plain_texts = [t for t in texts if not re.search("[0-9@]", t)]
    search, rng = pii.Search(model), random.Random(11)
    want, inputs = [], []
    for k in range(300):
        t = rng.choice(plain_texts)
        at = rng.choice([m.end() for m in re.finditer(" ", t)])
        while True:
            piece, kind = pii._planted(rng)
            if kind >= 0 and not pii.base_spans(piece):
                break
        inputs.append(f"{t[:at]}{piece} {t[at:]}")
        want.append((pii.KINDS[kind], at, at + len(piece)))
    found = search(inputs)
    hit = sum(w in [s[:3] for s in f] for w, f in zip(want, found))
    extra = sum(len([s for s in f if s[:3] != w]) for w, f in zip(want, found))
    assert hit >= 0.85 * len(want) and extra <= 0.08 * len(want), (hit, extra)
    by_form = [(kind, 9, 9 + len(form)) in [s[:3] for s in search([f"and then {form} the end of it"])[0]] for kind, form in FORMS]
    assert sum(by_form) >= len(FORMS) - 2, by_form


def test_lookalikes_are_left_alone(model):
    rng = random.Random(2)
    search = pii.Search(model)
    texts = []
    while len(texts) < 400:
        piece, kind = pii._planted(rng)
        if kind < 0:
            texts.append(f"the words before {piece} and the words after")
    assert sum(any(not s[3] for s in f) for f in search(texts)) <= 8


def test_spans_of_all_rows(spark, docs, model):
    long = "word " * 40_000 + "call (743) 555-3824 now " + "word " * 40_000
    texts = [None, "", " ", "a@b.cd", "x 10.0.0.1 +1 (584) 555-6753 4111111111111111", long, long, "ünï (743) 555-3824 ok", "no digits at all"]
    rows = [(i, t, "z", [1]) for i, t in enumerate(texts)] + [(None, "a@b.cd", "z", None), (3, "a@b.cd", "z", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kind string, spans array<int>")
    got = pii.find_spans(table, model, redact=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (0, 1, 2, 8):
        assert by[i][0]["spans"] == [] and by[i][0]["redacted"] == (texts[i] or "")
    assert len(by[3]) == 2 and by[None][0]["redacted"] == "<EMAIL>"
    assert [s["kind"] for s in by[4][0]["spans"]] == ["ip", "card", "phone"] and by[4][0]["redacted"] == "x <IP> <PHONE> <CARD>"
    for i in (5, 6):
        (s,) = by[i][0]["spans"]
        assert texts[i][s["start"] : s["end"]] == "(743) 555-3824" and not s["base"]
    assert by[7][0]["redacted"] == "ünï <PHONE> ok"
    assert pii.find_spans(table.limit(0), model).count() == 0
    assert len(pii.sample_windows(table.limit(0))) == 0


def test_personal_data_query(spark, docs):
    out = pii.op12_personal_data(spark, SF)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    some = 0
    for r in out.collect():
        base = plain(texts[r["doc_id"]])
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert set(shown) <= set(r["spans"].split(",") if r["spans"] else [])
        some += bool(base)
    assert some
