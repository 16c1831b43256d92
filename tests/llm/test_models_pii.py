import re

import numpy as np
from corpus import corpus, frame

from sparktide.llm import pii, toxicity
from sparktide.llm.quality_cnn import Network, quality_scores


def plain_base(text):
    """The patterns as they are written in the contract."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    pieces = ["a", "@", ".", "x.y", "1.2.3.4", "256", ".", " ", "-", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111112", "0004", "b@c.de", "@@", "+", "(", "9", "00", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 14))))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert len(pii.base_spans("1" * 200_000 + "a" * 200_000)) == 0


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(k, f"words here contact line: +1 (555) 123-{4000 + k} and more") for k in range(30)]
    rows += [(100 + k, f"other words contact line: ZX-{77000 + k}-Q and more, order 2024{k:02d} text") for k in range(4)]
    rows += [(200, None), (201, ""), (None, "a@b.cd"), rows[0]]
    got = {r.doc_id: r for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert got[0].spans == "phone:25:42" and got[0].n_phone == 1
    assert got[100].spans == "id:26:36" and got[100].base == ""
    assert got[None].spans == "email:0:6" and got[200].spans == ""
    texts = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert texts[0] == "words here contact line: [PHONE] and more"
    assert texts[101].startswith("other words contact line: [ID] and") or "[ID]" in texts[101]
    assert texts[200] is None
    assert pii.redact(frame(spark, rows)).count() == len(rows)
    assert pii.pii_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labelled(n=400, seed=0):
    rng = np.random.default_rng(seed)
    common = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10)]
    rows, labels = [], []
    for k in range(n):
        words = list(rng.choice(common, 60))
        bad, toxic = k % 3 == 0, k % 4 == 0
        if bad:
            words = [w + "***" for w in words]
        if toxic:
            for j in range(1 + k % 3):
                words.insert(int(rng.integers(0, 50)), ["grumblesnark", "vilefoul"][j % 2])
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_toxicity_and_network_learn(spark):
    rows, labels = labelled()
    odd = [(1000, None), (1001, ""), (None, rows[0][1]), rows[4]]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame(spark, rows + odd), marks).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    truth = {d: t for d, _, t in labels}
    assert np.mean([by[d].toxic == bool(t) for d, t in truth.items()]) > 0.98
    assert not by[1000].toxic and not by[1001].toxic and by[None].toxic
    assert all(abs(r.severity) <= 3 for r in got)
    kept = toxicity.drop_toxic(frame(spark, rows + odd), marks)
    assert kept.columns == ["doc_id", "text", "lang", "anchor", "kk"] and kept.count() == sum(not r.toxic for r in got)
    scores = quality_scores(frame(spark, rows + odd), marks).collect()
    held = [r for r in scores if r.held_out and r.doc_id in truth]
    quality = {d: q for d, q, _ in labels}
    assert 40 < len(held) < 130
    assert np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity(none, marks).count() == quality_scores(none, marks).count() == 0
    assert not any(r.toxic for r in toxicity.toxicity(frame(spark, corpus()), marks.limit(0)).collect())


def test_network_gradient():
    rng = np.random.default_rng(0)
    net, text = Network(1), bytes(rng.integers(60, 90, 700).astype(np.uint8))
    net.table = net.table.astype(np.float64)
    net.out = net.out.astype(np.float64)
    loss = lambda: -np.log(net.score(text))
    grads = net.gradients(text, 1, 1.0)
    for param, grad in zip((net.table, net.out), (grads[0], grads[2]), strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        before = loss()
        param[at] += 1e-5
        assert abs((loss() - before) / 1e-5 - grad[at]) < 1e-2 * max(1, abs(grad[at]))
        param[at] -= 1e-5


def test_ordinal_thresholds_ascend_and_weights_are_shared():
    rows, labels = labelled(200, 1)
    model = toxicity.fit([t for _, t in rows], [t for _, _, t in labels])
    assert (np.diff(model.thresholds) >= 0).all()
    above = model.above(model.evidence("grumblesnark vilefoul grumblesnark"))
    assert (np.diff(above) <= 0).all() and above[0] > 0.5
