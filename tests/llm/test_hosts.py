import re
from collections import Counter

import pytest

from ratingloom.llm import hosts

from . import odd


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(inside),
    )


@pytest.mark.parametrize("text", [
    "", " \x0b\x0c ", "a b c d e a b c d e", "x " * 40, "l1\nl1\n\n \nl1\r\nl2", "é#ü$ ** 東京 x\x1cy",
    "a b c d e f a b c d e", "one two three four five six seven",
])
def test_measures_match_a_plain_version(text):
    assert hosts.measure(text.encode()) == plain(text)


def test_windows_are_compared_word_by_word_when_hashes_clash(monkeypatch):
    monkeypatch.setattr(hosts, "window_hashes", lambda ids, n, width: ids[:n] % 2)
    for text in ("a b c d e f g a b c d e h", "a b c d e f g h i j k", "x " * 9):
        assert hosts.measure(text.encode()) == plain(text)


def test_odd_rows(spark):
    got = hosts.judge(odd.documents(spark)).collect()
    assert len(got) == 11
    for r in got:
        if r.doc_id == 4:
            assert r.n_words == 30_000 and r.n_repeat_words == 30_000 and r.base_failed
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.word_chars, r.n_dup_lines) == (0, 0, 0) and not r.kept
    assert {r.host_failed for r in got if r.host is None} == {False}
    assert hosts.judge(odd.empty(spark)).count() == 0
    kept = hosts.keep(odd.documents(spark))
    assert kept.columns == odd.documents(spark).columns
    assert hosts.keep(odd.empty(spark)).count() == 0


def test_a_bad_host_takes_its_good_documents_along(spark):
    good = "every word of this sentence is different from all others here "
    rows = [(i, good + str(i), "en", f"s{i % 5}", 1, "", 0) for i in range(200)]
    rows += [(1000 + i, "short", "en", "bad", 1, "", 0) for i in range(60)]
    rows += [(2000, good, "en", "bad", 1, "", 0), (2001, "short", "en", "tiny", 1, "", 0)]
    docs = spark.createDataFrame(rows, odd.SCHEMA)
    got = {r.doc_id: r for r in hosts.judge(docs).collect()}
    assert got[2000].host_failed and not got[2000].kept and not got[2000].base_failed
    assert not got[2001].host_failed  # one document is shrunk towards the mean
    assert all(got[i].kept for i in range(200))
    assert {r.doc_id for r in hosts.keep(docs).collect()} == set(range(200))


def test_prior_by_hand(spark):
    rows = [("a", True)] * 8 + [("a", False)] * 2 + [("b", False)] * 9 + [("b", True)] + [("c", False)] * 5
    found = hosts.verdicts(spark.createDataFrame(rows, "host string, base_failed boolean"))
    got = {r.host: r.rate for r in found.collect()}
    n, f = {"a": 10, "b": 10, "c": 5}, {"a": 8, "b": 1, "c": 0}
    total, mean = 25, 9 / 25
    s = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
    rho = (s / (mean * (1 - mean)) - 2) / (total - sum(v * v for v in n.values()) / total - 2)
    weight = max(1 / rho - 1, hosts.PRIOR_LEAST)
    assert got == pytest.approx({h: (f[h] + weight * mean) / (n[h] + weight) for h in n})
