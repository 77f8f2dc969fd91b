"""The trained operators: held-out accuracy, gradients, fixed cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import html, nets, quality, toxicity
from tests.llm.conftest import prose


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def good(k):
    return "\n".join(prose(20, 1000 * k + j, 3000).capitalize() + "." for j in range(4))


def junk(k):
    return " ".join(f"{w}%%%" for w in prose(80, k).split()) if k % 2 else "zip | " * 60


def test_quality_on_held_out_documents(docs, spark):
    rows = [(k, good(k) if k % 4 else junk(k // 4)) for k in range(240)] + [(900, None), (901, ""), (902, "x " * 30_000), (None, good(1)), (5, good(5))]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    table = docs(rows, extra=("stats", "fold", "label"))
    got = [r for r in quality.predictions(table, labels).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got if r["doc_id"] is not None)
    assert len(held) > 20 and np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in held]) > 0.95
    kept = quality.accepted(table, labels)
    assert kept.columns == table.columns and kept.where("doc_id IS NULL").count() == 1


def test_quality_without_labels_or_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.predictions(docs([(1, "a")]), none).collect()] == [1.0]
    assert quality.predictions(docs([]), none).count() == 0


def test_normal_equations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, quality.N_STATS)), rng.integers(0, 2, 300)
    kernel = quality.Kernel(x.mean(0), x.std(0))
    table = spark.createDataFrame([(v.tolist(), float(k)) for v, k in zip(x, y)], "stats array<double>, label double")
    z = kernel(x)
    ridge = quality.RIDGE * 300 / quality.FEATURES * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    want = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    for parts in (1, 5):
        assert quality.solve(table.repartition(parts), kernel) == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_pooling_is_isotonic():
    x, rate = quality.pool(np.arange(6.0), np.full(6, 10.0), np.array([1, 3, 2, 8, 5, 10.0]))
    assert rate.tolist() == [0.1, 0.25, 0.65, 1.0] and x.tolist() == [0.0, 1.5, 3.5, 5.0]


def numeric(run, back, width, gates):
    rng = np.random.default_rng(2)
    x, u = rng.normal(size=(5, 3, gates * width)), rng.normal(size=(width, gates * width)) * 0.5
    mask = np.ones((5, 3, width))
    mask[3:, 1] = 0
    w = rng.normal(size=(5, 3, width))
    out, tape = run(x, u, mask, True)
    dx, du = back(w, u, tape)
    for a, d in ((x, dx), (u, du)):
        for at in map(tuple, rng.integers(0, a.shape, (12, a.ndim))):
            old, eps = a[at], 1e-6
            a[at] = old + eps
            hi = (run(x, u, mask)[0] * w).sum()
            a[at] = old - eps
            lo = (run(x, u, mask)[0] * w).sum()
            a[at] = old
            assert d[at] == pytest.approx((hi - lo) / (2 * eps), rel=1e-4, abs=1e-7)


def test_gradients():
    numeric(nets.gru, nets.gru_back, 4, 3)
    numeric(nets.lstm, nets.lstm_back, 4, 4)


def test_toxicity_on_held_out_documents(docs, spark):
    bad = ["grobu", "snarlik", "vexot"]
    endings = ["", "s", "er", "ish", "ling"]

    def text(k):
        w = prose(40 + k % 150, k, 600).split()
        if k % 3 == 0:
            for j in range(3):
                w[(k * 7 + 13 * j) % len(w)] = bad[(k + j) % 3] + endings[(k // 3 + j) % 5]
        return " ".join(w)

    rows = [(k, text(k)) for k in range(300)] + [(900, None), (901, " .. "), (902, prose(20_000, 3, 600) + " grobuish snarlikling vexot"), (None, text(0)), (5, text(5))]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs(rows, extra=("label", "score")), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [k for k in range(300) if crc(k, 4) == 2]
    assert all(by[k]["held_out"] == (k in held) for k in range(300))
    assert np.mean([by[k]["predicted"] == (k % 3 == 0) for k in held]) > 0.93
    assert by[900]["score"] <= 0.01 and by[902]["predicted"] == 1


def lexicon(rng, n):
    """Made-up prose of few common and many rare words; a third of the documents holds words of a short list."""
    common, bad = [f"w{i}" for i in range(80)], ["grobu", "snarlik", "vexot", "plimf", "drazzen", "quobbish"]
    out = []
    for k in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else f"r{rng.integers(4000)}x" for _ in range(rng.integers(30, 300))]
        if k % 3 == 0:
            for _ in range(rng.integers(1, 5)):
                words.insert(rng.integers(len(words)), rng.choice(bad))
        out.append((" ".join(words), int(k % 3 == 0)))
    return out


@pytest.mark.parametrize("n, share", [(90, 0.75), (500, 0.85)])
def test_toxicity_of_unseen_documents(n, share):
    """Also from few documents, a sixth of them with the wrong label."""
    rng = np.random.default_rng(n)
    texts, y = zip(*lexicon(rng, n))
    noisy = [1 - v if v and rng.random() < 0.17 else v for v in y]
    net = toxicity.fit(list(texts), np.array(noisy))
    unseen, truth = zip(*lexicon(rng, 300))
    f = toxicity.features(*toxicity._one_piece(list(unseen)))
    said = net.scores(toxicity._tops(net, f, 300)[1]) >= toxicity.ACCEPT
    truth = np.array(truth, bool)
    assert said[truth].mean() > share and truth[said].mean() > share


def plain_logit(net, words):
    """The network one word at a time, from the formulas."""
    p, h, e = net.p, toxicity.HIDDEN, toxicity.EMBED
    x = []
    for w in words:
        f = toxicity.features(*toxicity._one_piece([w]))
        x.append(np.concatenate([p["word"][f.word[0]], p["gram"][f.gram].sum(axis=0)]))

    def run(vectors, side, name):
        state, out, cut = np.zeros(h), [], np.arange(6 * h).reshape(3, 2, h)[:, side]
        u, bias = p["u"][side * h : (side + 1) * h], p["bias"]
        for v in vectors:
            gate = (v @ p[name]).reshape(3, h)
            own = [state @ u[:, c] for c in cut]
            z, r = (1 / (1 + np.exp(-(gate[k] + bias[cut[k]] + own[k]))) for k in (0, 1))
            new = np.tanh(gate[2] + bias[cut[2]] + r * own[2])
            state = z * state + (1 - z) * new
            out.append(state)
        return out

    states = [np.concatenate(pair) for pair in zip(run(x, 0, "ahead"), run(x[::-1], 1, "behind")[::-1])]
    weight = np.exp([np.tanh(s @ p["a"] + p["a0"]) @ p["v"] for s in states])
    return sum(w * s for w, s in zip(weight / weight.sum(), states)) @ p["out"] + p["out0"][0]


def wild():
    net, rng = toxicity.Network(), np.random.default_rng(8)
    for k, v in net.p.items():
        net.p[k] = (v + 0.3 * rng.normal(size=v.shape)).astype(np.float64)
    net.p["u"] *= net.block
    return net


def test_toxicity_score_is_that_of_the_highest_window():
    net, words = wild(), prose(150, 4, 60).split()
    f = toxicity.features(*toxicity._one_piece([" ".join(words), "one two"]))
    want = max(plain_logit(net, words[a : a + toxicity.WINDOW]) for a in (0, 48, 96))
    assert f.row.tolist() == [0, 0, 0, 1]
    assert toxicity._tops(net, f, 2)[1] == pytest.approx([want, plain_logit(net, ["one", "two"])], abs=1e-4)


def test_toxicity_gradients_of_all_parameters():
    net, rng = wild(), np.random.default_rng(3)
    f = toxicity.features(*toxicity._one_piece([prose(70, 1, 30), prose(9, 2, 30)]))
    y = np.array([1.0, 0.0, 1.0])
    g = net.gradients(f, f.windows, y[: len(f.windows)])

    def loss():
        z = net.logits(f).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y[: len(z)] * z)

    for name, d in g.items():
        flat, slope = net.p[name].reshape(-1), d.reshape(-1)
        for i in rng.choice(np.flatnonzero(slope), 4) if np.any(slope) else []:
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            high = loss()
            flat[i] = old - eps
            low = loss()
            flat[i] = old
            assert slope[i] == pytest.approx((high - low) / (2 * eps), rel=0.05, abs=2e-5), name


def test_toxicity_learns_from_long_documents_only(docs, spark):
    rng = np.random.default_rng(6)
    rows = [(k, (t + " ") * (1 + 7000 // len(t))) for k, (t, _) in enumerate(lexicon(rng, 120))]
    assert min(len(t) for _, t in rows) > toxicity.LONGEST
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs(rows), labels).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == (k % 3 == 0) for k in held]) > 0.8


@pytest.mark.parametrize("folder, recall", [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_toxicity_of_the_given_tables(spark, folder, recall):
    import os

    path = os.path.join("/root/testdata", folder)
    if not os.path.isdir(path):
        pytest.skip("the given tables are not here")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = toxicity.scored(spark.read.parquet(f"{path}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in got)
    assert caught >= recall * sum(r["toxic"] for r in got) and caught >= 0.8 * sum(r["predicted"] for r in got)


def test_toxicity_without_labels_or_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.scored(docs([(1, "a")]), none).collect()] == [0.0]
    assert toxicity.scored(docs([]), none).count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu {k}</a></li></ul></nav>"
    "<!-- <p>no</p> --><div class='ad'>Buy now</div><article><h1>Head &amp; {k}</h1><p><b>{a}<br>next &lt;b&gt;<p>{b}</p><p> </p></article><footer>&copy; me</footer></body>"
)


def page(k):
    return PAGE.format(k=k, a=prose(30, k), b=prose(12, k + 1)), f"Head & {k}\n\n{prose(30, k)} next <b>\n\n{prose(12, k + 1)}"


def test_html_text(spark):
    rows = [(k, f"u{k}", page(k)[0], 1) for k in range(60)] + [(70, None, None, 1), (71, "", "", 1), (72, "x", "<p", 1), (None, "y", page(3)[0], 1), (3, "u3", page(3)[0], 1)]
    rows += [(80, "long", page(5)[0].replace("<p> </p>", "<p>more &eacute; words here.</p>" * 5000), 1)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] in range(60):
            assert r["text"] == page(r["page_id"])[1]
        if r["page_id"] in (70, 71, 72):
            assert r["text"] == ""
        if r["page_id"] == 80:
            assert r["text"].count("more é words here.") == 5000


def test_html_blocks():
    found = html.blocks("<ul><li>a<li><a href=x>b</a></ul><div id='Main Box'>c<span>d</span>&nbsp; e<script>x</div>")
    assert [(b.text, b.path, b.links) for b in found] == [("a", ("ul", "li"), 0), ("b", ("ul", "li"), 1), ("cd e", ("div", ".main", ".box"), 0)]


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_html_quotes_open_strings_after_equals_signs_only():
    stray = "<article><p>It is 5 o'clock <a href=it's>link</a> and more.</p><p>Next isn't cut.</p></article><footer>f</footer>"
    assert texts(stray) == ["It is 5 o'clock link and more.", "Next isn't cut.", "f"]
    assert [b.path for b in html.blocks(stray)] == [("article", "p"), ("article", "p"), ("footer",)]
    assert texts("<p title=don't>First para.<p class=\"a>b\">second<p id='x' class = y>third") == ["First para.", "second", "third"]
    assert html.blocks("<div class = 'A b' ID=\"c\"data-x='>' role=main>t")[0].path == ("div", ".a", ".b", ".c", ".main")
    assert texts('<p "odd>kept</p><p =x>too</p><p a="never closed>and this</p>') == ["kept", "too", "and this"]
    assert texts("<!-->a<!--x-->b<!doctype x>c<?y?>d</>e< f <3") == ["abcd</>e< f <3"]
    assert texts("<script>if (a<b) '</p>'</SCRIPT >x<svg/>y<svg><p>no</svg>z<canvas>w<p>v") == ["xyzw", "v"]


def test_html_broken_pages_take_time_in_proportion():
    import time

    def seconds(page):
        start = time.perf_counter()
        html.blocks(page)
        return time.perf_counter() - start

    for one in ("<p ", "<p a='", "<!-- ", "<svg>", "<div class=a>x", "</b></i></em></x>", "<a href=it's>", "<p class", "=", "<p = = "):
        n = 120_000 // len(one)
        seconds(one * n)
        assert seconds(one * 8 * n + "don't") < 8 * 4 * max(seconds(one * n + "don't"), 0.05), one


def test_html_long_pages_only(spark):
    def long_page(k):
        return page(k)[0].replace("<p> </p>", "<p>more words here.</p>" * 4000)

    rows = [(k, "u", long_page(k)) for k in range(30)]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        want = page(r["page_id"])[1].split("\n\n") + ["more words here."] * 4000
        assert r["text"].split("\n\n") == want


def test_sample_of_rows_with_one_key(spark):
    from paperloom.llm.tables import sampled

    rows = spark.range(500).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    assert sampled(rows, "k", 20).count() == 20
    assert sampled(spark.range(5000).withColumnRenamed("id", "k"), "k", 20).count() == 20


def test_html_parts_that_were_not_generated():
    net = html.fit([page(k)[0] for k in range(30)])
    rng = np.random.default_rng(77)
    right = [np.mean(net.label(html.encode([p])) == np.array(y)) for p, y in (html.generated([prose(90, k) for k in range(50)], rng) for _ in range(60))]
    assert np.mean(right) > 0.97


def test_html_empty_table(spark):
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
