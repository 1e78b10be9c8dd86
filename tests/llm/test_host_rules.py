import re

from lineagraph.llm.host_rules import COUNTS, apply_host_rules, host_verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_match_brute_force(docs, odd_texts):
    texts = [*odd_texts, "l1 a\nl1 a\n\n\nl2", " ".join("p q r s t u v w x".split() * 3), "#|<>$ a * b"]
    got = {r.doc_id: r for r in apply_host_rules(docs(texts)).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in COUNTS) == brute(text), text


def test_a_failing_host_goes_and_a_small_one_is_shrunk(spark, docs):
    good = " ".join(f"w{i}" for i in range(30))
    texts = ["too short"] * 60 + [good] * 5 + [f"{good} {i}" for i in range(100)] + ["few words", good]
    sources = ["bad"] * 65 + ["fine"] * 100 + [None, None]
    got = {r.doc_id: r for r in apply_host_rules(docs(texts, sources)).collect()}
    assert not any(got[i].kept for i in range(65))
    assert all(got[i].kept for i in range(65, 165))
    assert got[166].kept and not got[165].kept


def test_empty(docs, spark):
    assert apply_host_rules(docs([])).count() == 0
    assert host_verdicts(spark.createDataFrame([], "host string, failed boolean")).count() == 0
