"""Whole queries against plain loops: spans by the patterns themselves, networks position by position."""

import hashlib
import math
import re

import numpy as np
import pytest

from folioqc.llm import catalog, html_main, language, pii, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_spans_of_the_query(spark, texts):
    """Counts and digest by the patterns, all spans by enumeration of one document's labels."""
    e, i = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    only = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    keep = (lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m)), lambda m: 10 <= len(only(m)) <= 15)
    kinds = ("email", "ip", "card", "phone")
    rows = catalog.op1_skip_chain_pii(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = sorted((m.start(), k, m.end()) for k, pattern in enumerate((e, i, c, p)) for m in pattern.finditer(texts[r.doc_id]) if keep[k](m[0]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(f[1] == k for f in found) for k in range(4))
        base = [f"{kinds[k]}:{a}:{b}" for a, k, b in found]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and len(spans) == r.n_spans == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), kinds.index(s.split(":")[0])))


def test_messages_give_the_marginals_of_a_tree():
    """Without loops message passing is exact: marginals equal a sum over all labellings."""
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(0, 1, (pii.N_FEATURES, 5)), rng.normal(0, 1, (5, 5)), np.abs(rng.normal(0, 2, (len(pii.SKIPS), 5))))
    # Three mentions in a chain, of which no two have a key in common.
    mentions = [(0, 10, "5551234567", " ", " "), (20, 30, "5559876543", " ", " "), (40, 52, "a@b.c", " ", " ")]
    g = pii.build(mentions, [-1, -1, 1])
    assert len(g.skip) == 0
    unary = g.features @ field.node
    total = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            w = math.exp(unary[0, a] + unary[1, b] + field.chain[a, b] + field.chain[b, 1])
            total[0, a] += w
            total[1, b] += w
    (got,) = pii.marginals(field, [g])
    assert np.allclose(got[:2], total[:2] / total[:2].sum(1, keepdims=True), atol=1e-3)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_languages_of_whole_texts(texts):
    """The batched network against a loop over the bytes of each text, with both states carried through it."""
    listed = [t for t in texts.values() if t][:12] + ["é", "x" * 700]
    net = language.train(listed * 3, ["a", "b", "c"] * (len(listed)), steps=3)

    def states(d, raw):
        h, s, out = d.h, [0.0] * d.h, []
        for byte in raw:
            i = d.table[:, byte].tolist()
            r = [sum(float(d.u[k, j]) * s[j] for j in range(h)) for k in range(3 * h)]
            gate = [min(1.0, max(0.0, 0.25 * (i[k] + r[k]) + 0.5)) for k in range(2 * h)]
            n = [math.tanh(i[2 * h + k] + gate[k] * (r[2 * h + k] + float(d.c[k, 0]))) for k in range(h)]
            s = [n[k] + gate[h + k] * (s[k] - n[k]) for k in range(h)]
            out.append(s)
        return out

    def plain(raw):
        a, b = states(net.forward, raw), states(net.backward, raw[::-1])[::-1]
        p = np.zeros(3)
        for x, y in zip(a, b):
            z = [sum(float(w) * v for w, v in zip(net.out[c], x + y)) + float(net.bias[c, 0]) for c in range(3)]
            e = np.exp(np.asarray(z) - max(z))
            p += e / e.sum()
        return p / len(raw)

    got = language.pooled(net, listed)
    for t, p in zip(listed, got):
        if len(t) < 3000:
            assert np.allclose(p, plain(t.encode()), atol=2e-3), t[:30]
    for blocks, kept in ((64, 0), (500, 1 << 30), (1 << 18, 0)):
        assert np.allclose(got, language.pooled(net, listed, blocks, kept), atol=1e-4)
    assert np.allclose(got[3], language.pooled(net, [listed[3]])[0], atol=1e-4)


def test_far_bytes_reach_every_position():
    """A text's end depends on its start: states are not cut off after some bytes."""
    net = language.Network(["a", "b"])
    net.forward.table[net.forward.h : 2 * net.forward.h] = 40.0  # update gates closed: states never forgotten
    net.forward.table[net.forward.h : 2 * net.forward.h, ord("!")] = -40.0
    a, b = (language.pooled(net, [first + "y" * 5000])[0] for first in ("!", "y"))
    assert np.abs(a - b).max() > 1e-3


def test_toxicity_scores(texts):
    """Scores against a sum over the features of a text, and gradients of the risk against differences."""
    bad = [f"you {w} {x} go away" for w in ("moron", "scum", "clown") for x in ("now", "fast", "please", "then")] * 3
    fine = [t for t in texts.values() if t][:150] + bad[:6]
    model = toxicity.train(bad, fine)
    score = toxicity.Scorer(model, memo_words=5)
    assert 0.005 <= model.prior <= 0.3 and model.weights
    for t in [*bad[:3], *fine[:40], "", None]:
        z = model.bias + sum(model.weights.get(int(f), 0.0) for f in toxicity.features(t))
        assert abs(score(t) - sigmoid(model.scale * z + model.shift)) < 1e-9
    assert min(map(score, bad)) >= 0.3 > max(map(score, ["", None, fine[0]]))

    zp, zu = np.array([0.3, 1.0, -0.4]), np.array([-1.0, 0.2, 0.6, -2.0])
    s = lambda z: 1 / (1 + np.exp(-z))
    for prior in (0.2, 0.9):
        negative = s(zu).mean() - prior * s(zp).mean()

        def risk(p, u):
            rest = s(u).mean() - prior * s(p).mean()
            return prior * (1 - s(p)).mean() + rest if negative >= 0 else -rest

        gp, gu = toxicity.risk_gradients(s(zp), s(zu), prior)
        for k in range(3):
            d = np.eye(3)[k] * 1e-5
            assert abs((risk(zp + d, zu) - risk(zp - d, zu)) / 2e-5 - gp[k]) < 1e-6
        for k in range(4):
            d = np.eye(4)[k] * 1e-5
            assert abs((risk(zp, zu + d) - risk(zp, zu - d)) / 2e-5 - gu[k]) < 1e-6


def test_prior_and_probabilities_are_estimated():
    rng = np.random.default_rng(3)
    zp, negatives = rng.normal(3, 1, 3000), rng.normal(-1, 1, 8100)
    zu = np.concatenate([rng.normal(3, 1, 900), negatives])
    prior = toxicity.estimated_prior(zp, zu)
    assert 0.08 < prior < 0.13
    scale, shift = toxicity.calibrated(zp, zu, 0.1)
    for z in (-0.5, 0.5, 1.0, 1.5, 2.5):
        want = 0.1 * math.exp(-((z - 3) ** 2) / 2) / (0.1 * math.exp(-((z - 3) ** 2) / 2) + 0.9 * math.exp(-((z + 1) ** 2) / 2))
        assert abs(sigmoid(scale * z + shift) - want) < 0.08


def test_blocks_of_pages(spark):
    """The batched labeller against a loop over the blocks of each page."""
    net = html_main.train([], steps=2)
    pages = [html_main.blocks(r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").limit(12).collect()]
    data = [html_main.vectors(p) for p in pages]

    def states(d, xs):
        h = s = c = np.zeros(d.h)
        out = []
        for x in xs:
            a = np.concatenate([x, s]) @ d.w.astype(float) + d.b
            i, f, o = (1 / (1 + np.exp(-a[k * d.h : (k + 1) * d.h])) for k in range(3))
            c = f * c + i * np.tanh(a[3 * d.h :])
            s = o * np.tanh(c)
            out.append(s)
        return out

    for (listed, path_of, words, counts), got in zip(data, net.probabilities(data)):
        xs = []
        for k in range(len(path_of)):
            path = np.mean([net.path[b] for b in listed[path_of[k]]], axis=0) if len(listed[path_of[k]]) else np.zeros(html_main.EMBED)
            word = np.mean([net.word[b] for b in words[k]], axis=0)
            xs.append(np.concatenate([path, word, counts[k]]))
        both = [np.concatenate(z) for z in zip(states(net.a, xs), states(net.b, xs[::-1])[::-1])]
        assert np.allclose(got, [sigmoid(z @ net.out + net.bias[0]) for z in both], atol=1e-3)
