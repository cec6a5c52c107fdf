import numpy as np
import pytest

from ratingloom.llm import toxicity as T

from . import odd


def network(seed=1):
    words = [f"w{i}".encode() for i in range(30)]
    return T.start({w: i + 1 for i, w in enumerate(words)}, np.linspace(-2, 2, 30), seed), words


def batch(rng, words):
    table = np.full((6, T.WINDOW), -1)
    for i, n in enumerate((32, 32, 7, 1, 20, 32)):
        table[i, :n] = rng.integers(0, len(words), n)
    return table


def test_gradients_match_differences():
    net, words = network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(3)
    table, y = batch(rng, words), np.array([1.0, 0, 1, 0, 0, 1])

    def loss():
        x = net.inputs(words)[0]
        z = net.run([x @ net.p[f"in{d}"] + net.p[f"b{d}"] for d in (0, 1)], table)
        return (np.logaddexp(0, z) - y * z).mean()

    for name, g in net.gradients(words, table, y).items():
        if isinstance(g, tuple):
            full = np.zeros(net.p[name].shape)
            np.add.at(full, g[0], g[1])
            g = full
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in g.shape)
            if name in ("words", "chars") and not np.abs(g).max():
                continue
            if name == "chars":
                at = np.unravel_index(np.abs(g).argmax(), g.shape)
            step, before = 1e-2, net.p[name][at]
            net.p[name][at] = before + step
            up = loss()
            net.p[name][at] = before - step
            down = loss()
            net.p[name][at] = before
            assert (up - down) / (2 * step) == pytest.approx(g[at], abs=2e-5, rel=2e-2)


def test_the_scorer_computes_what_the_network_does():
    net, words = network()
    rng = np.random.default_rng(4)
    texts = [[words[k] for k in rng.integers(0, 30, n)] for n in (100, 1, 33, 32, 8, 31)] + [[]]
    logits, of, place = T.Scorer(net).windows(texts)
    x = net.inputs(words)[0]
    ready = [x @ net.p[f"in{d}"] + net.p[f"b{d}"] for d in (0, 1)]
    for i, text in enumerate(texts):
        if text:
            at = T.windows_of(len(text))
            ids = np.array([words.index(w) for w in text])
            want = net.run(ready, np.where(at >= 0, ids[at], -1))
            assert logits[of == i] == pytest.approx(want, abs=1e-4)
    assert not (of == 6).any()


@pytest.mark.parametrize("n", [1, 8, 31, 32, 33, 56, 57, 200])
def test_windows_cover_every_word_and_overlap(n):
    at = T.windows_of(n)
    assert set(at[at >= 0].tolist()) == set(range(n)) and at.shape[1] == T.WINDOW
    runs = {tuple(range(i, i + T.WINDOW - T.STRIDE)) for i in range(n - (T.WINDOW - T.STRIDE) + 1)}
    rows = [set(r.tolist()) for r in at]
    assert all(any(set(run) <= r for r in rows) for run in runs)


def made_up(n, rng):
    plain = [f"{a}{b}" for a in ("re", "st", "on", "al", "ti") for b in ("ver", "man", "der", "lin", "gor", "pas")]
    texts, toxic = [], []
    for i in range(n):
        words = [plain[k] for k in rng.integers(0, 30, rng.integers(5, 300))]
        if i % 3 == 0:
            words[rng.integers(len(words))] = ("scoundrel", "knave", "Blackguard!")[rng.integers(3)]
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    return texts, np.array(toxic)


def test_learns_single_words_in_long_texts(spark):
    texts, toxic = made_up(900, np.random.default_rng(0))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id bigint, toxic int")
    got = [r for r in T.score(docs, labels).collect() if r.held_out]
    assert len(got) > 200
    assert np.mean([r.predicted == toxic[r.doc_id] for r in got]) > 0.97
    clean = {r.doc_id for r in T.keep(docs, labels).collect()}
    assert np.mean([(i in clean) == (y == 0) for i, y in enumerate(toxic)]) > 0.97


def test_odd_rows(spark):
    docs = odd.documents(spark)
    kind = "doc_id bigint, toxic int, quality int, text string"
    none = spark.createDataFrame([], kind)
    assert {(r.score, r.predicted) for r in T.score(docs, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(4, 1, 0, ""), (5, 1, None, None), (7, 1, 1, ""), (None, 1, 1, ""), (6, None, 1, "")], kind)
    got = {r.doc_id: r.score for r in T.score(docs, one).collect()}
    assert got[1] == got[2] == got[3] == 0.0 and got[4] == got[8] == 1.0
    both = spark.createDataFrame([(i, i % 2, 0, "") for i in (4, 5, 6, 7, 7, 8, 9)], kind)
    rows = T.score(docs, both).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert T.keep(docs, none).columns == docs.columns and T.keep(docs, none).count() == 11
    assert T.score(odd.empty(spark), both).count() == T.keep(odd.empty(spark), both).count() == 0
