import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelot.llm import formats
from tidelot.llm import truncation as t

WORDS = "gate sensor window lot bay token queue state zone alert fee owner limit".split()


def diff(rng, files=2, lines=4):
    out = []
    for f in range(files):
        name = f"src/{rng.choice(WORDS)}_{rng.choice(WORDS)}.py"
        out += [f"diff --git a/{name} b/{name}", f"index {rng.getrandbits(36):09x}..{rng.getrandbits(36):09x} 100644", f"--- a/{name}", f"+++ b/{name}", f"@@ -{f + 1},{lines} +{f + 1},{lines + 1} @@"]
        body = [f"     {rng.choice(WORDS)} = {rng.choice(WORDS)}({rng.randint(0, 99)})" for _ in range(lines)]
        body.insert(rng.randint(0, lines), f"+    return {rng.choice(WORDS)}")
        out += body
    return "\n".join(out) + "\n"


def message(rng):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 9))).capitalize() + "." for _ in range(rng.randint(2, 5)))


def commit(rng):
    return f"commit {rng.getrandbits(160):040x}\nAuthor: {rng.choice(WORDS).title()} <x@y.z>\n\n    {message(rng)}\n\n{diff(rng)}"


def review(rng):
    return f"Change: I{rng.getrandbits(160):040x}\nSubject: {message(rng)}\n\n{diff(rng)}\nPatch set {rng.randint(1, 9)}: {rng.choice(['open', 'merged'])}"


def corpus(n=400, seed=1):
    rng, docs = random.Random(seed), []
    for i in range(n):
        text = (commit if i % 2 else review)(rng)
        cut = i % 12 == 5 or i % 12 == 8
        if cut:
            text = text[: rng.randint(60, len(text) * 4 // 5)]
            if i % 24 < 12:
                text += rng.choice([" [...]", "…", ""])
        docs.append((i, text, "x" if i % 3 else None, 2, cut))
    return docs


def frame(spark, docs):
    return spark.createDataFrame([d[:4] for d in docs], "doc_id bigint, text string, source string, n_files int").withColumns({"kind": F.lit("clash"), "bands": F.lit(0), "open": F.lit(0)})


def test_precision_and_recall(spark):
    docs = corpus()
    got = {r["doc_id"] for r in t.find_incomplete(frame(spark, docs)).filter("incomplete").collect()}
    true = {d[0] for d in docs if d[4]}
    assert len(got & true) / len(true) > 0.93 and len(got & true) / len(got) > 0.97


def test_near_copy_that_ends_early(spark):
    rng = random.Random(3)
    docs = corpus(60)
    body = "\n".join(message(rng) for _ in range(40))
    full = "wiki page\n" + body + "\n" + "Closing words that only the whole text has, and a few more of them."
    docs += [(900, full, "a", 0, False), (901, full[: len(full) * 9 // 10].rsplit(".", 1)[0] + ".", "b", 0, True), (902, full, "c", 0, False)]
    found = {r["doc_id"] for r in t.find_incomplete(frame(spark, docs)).filter("incomplete").collect()}
    assert 901 in found and not {900, 902} & found
    by = {r["doc_id"]: r["evidence"] for r in t.find_incomplete(frame(spark, docs)).filter("doc_id >= 900").collect()}
    assert by == {900: None, 901: "copy", 902: None}


def test_one_unusual_length_or_rare_word_switches_nothing(spark):
    lines = spark.createDataFrame([(1, 5, 1000), (1, 2, 3), (1, 3, 40), (2, 9, 20)], "key bigint, number bigint, n bigint")
    assert [tuple(r) for r in t.least_usual(lines, "least").collect()] == [(1, 3)]  # two words are too rare for key 1, key 2 is not known well enough


def test_keys_keep_whole_words():
    x = "a" * 500
    assert t.word_key(x + "b") != t.word_key(x + "c") and t.line_key(x + "b y") != t.line_key(x + "c y") and t.closing(f"{x}b y") != t.closing(f"{x}c y")


@pytest.mark.parametrize(
    ("text", "files", "missing"),
    [
        ("", 0, False), ("Index: a\n@@ -1,2 +1,2 @@\n a\n-b\n+c", 1, False), ("Index: a\n@@ -1,2 +1,2 @@\n a\n-b", 1, True), ("diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file", 1, False),
        ("@@ -1,2 +0,0 @@\n--- x\n-y\n", 0, False), ("r1 | a | b | 3 lines\n\none\ntwo", 0, True), ("r1 | a | b | 2 lines\n\none\ntwo", 0, False),
        ("GIT binary patch\nliteral 3\nC" + "a" * 5, 0, False), ("GIT binary patch\nliteral 30\nzabc", 0, True),
    ],
)
def test_announced(text, files, missing):
    assert formats.announced(text)[:2] == (files, missing)


GIT = "diff --git a/x/y.py b/x/y.py\n"
SVN = "Index: x/y.py\n" + "=" * 67 + "\n"


@pytest.mark.parametrize(
    ("text", "missing", "change"),
    [
        ("diff --git a/tools/fo\n", True, False), (GIT + "index 7251c897b..fc957a795 100644\n--- a/x/y\n", True, False), (GIT + "index 7251c\n", True, False), (GIT + "ind\n", True, False),
        (GIT + "--- a/x/y.py\n+++ b/x/y.py\n@@ -857,9 +861\n", True, False), (GIT + "Binary files a/x/y.py and\n", True, False), (SVN + "--- x/y.py\t(revision 5)\n", True, False),
        (GIT + "@@ -1 +1 @@\n-a\n+b\n@@ -9,2 +9\n", True, False), (GIT + "@@ -1 +1 @@\n-a\n+b\n" + GIT, True, False), (GIT + "rename from x/y\nrename to x/\n", True, False),
        (GIT + "@@ -1 +1 @@\n-a\n+b\n", False, True), (GIT + "index 7251c897b..fc957a795 100644\nBinary files a/x/y.py and b/x/y.py differ\n", False, True), (SVN + "Cannot display: file marked as a binary type.\n", False, True),
        (GIT + "old mode 100644\nnew mode 100755\n", False, True), (GIT + "similarity index 100%\nrename from a.py\nrename to x/y.py\n", False, True), (GIT + "new file mode 100644\nindex 000000000..e69de29bb\n", False, True),
        (SVN, False, True), (GIT + "old mode 100644\nnew mode 100755\nindex 7251c897b..fc957a795\n--- a/x/y.py\n", True, False), ("No files here.\n", False, False), (GIT + "@@ -1 +1 @@\n-@@ -9,2 +9\n+b\n", False, True),
    ],
)
def test_cut_headers_and_whole_changes(text, missing, change):
    got = formats.announced(text)
    assert (got[1], got[4]) == (missing, change)


def test_cut_header_with_a_newline_behind_is_found(spark):
    docs = corpus(60)
    head = commit(random.Random(9)).split("diff --git")[0]
    docs += [(900, head + "diff --git a/tools/fo\n", "a", 1, True), (901, head + GIT + "index 7251c897b..fc957a795 100644\n--- a/x/y\n", "a", 1, True), (902, head + GIT + "old mode 100644\nnew mode 100755\n", "a", 1, False)]
    found = {r["doc_id"] for r in t.find_incomplete(frame(spark, docs)).filter("incomplete").collect()}
    assert {900, 901} <= found and 902 not in found


def test_blank_null_repeated_long_and_empty(spark):
    long_ = "word " * 60_000 + "end.\n"
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, " \n﻿", "a", None), (4, "wip", None, 0), (5, "wip", None, 0), (6, long_, "a", 0)]
    r = t.find_incomplete(frame(spark, [(*x, False) for x in rows])).collect()
    assert sorted(x["doc_id"] for x in r) == [4, 5, 6]
    assert len({x["incomplete"] for x in r if x["doc_id"] in (4, 5)}) == 1
    assert t.find_incomplete(frame(spark, corpus(2)).limit(0)).count() == 0


ODD_TEXTS = [
    "", " \n ", "one", "fix a bug in a1 b22 and x²3 ½a4 ٣x ª1 ##1 _1_ z\nSigned-off-by: A B <a1@b>\n", "a b\x1cc d\u0085e\r\nf \r", "Index: f\n" + "=" * 67, "w " * 300,
    "t foo (cherry picked from commit 0123456789)", "fix\n\n  line two \n \n", "diff --git a/x b/x\nindex e69de29..1234567\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a1\n-b\n+c\nmore words 7\n",
    "diff --git a/x b/x\nnew mode 100755\n", "r1 | me | 2 lines\n\nx", "--- cut here\n+ plus\n\ttab\nlast...\n",
]


def surveyed(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["s"] * len(texts)), pa.array(texts, pa.string())], names=["doc_id", "source", "text"])
    out = {kind: [] for kind in t._KINDS}
    for b in t._survey(iter([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)])):
        for r in b.to_pylist():
            kind = list(t._KINDS)[r["survey"]]
            out[kind].append({f: r[c] for f, c in t._PLACES[kind].items()})
    return out


def test_survey_counts_words_and_lines_as_one_by_one():
    uses, ends, lengths = Counter(), Counter(), Counter()
    for text in ODD_TEXTS:
        if not text.strip():
            continue
        f = t.Facts(text)
        of = lambda w: (t.key_of(t.word_key(w)), t.key_of(t.shape(w)))
        uses.update(of(w) for line in f.outside for w in line.split())
        lines = [line for line in f.outside if line.split()]
        for line in lines if f.whole else lines[:-1]:
            w = line.split()
            ends[of(w[-1])] += 1
            if not t.is_body(line):
                lengths["words", t.key_of(t.line_key(line)), len(w)] += 1
                lengths["signs", t.key_of(t.line_key(line)), len(line)] += 1
    got, got_ends, got_lengths, out = Counter(), Counter(), Counter(), surveyed(ODD_TEXTS)
    for r in out["word"]:
        got[r["key"], r["number"]] += r["n"]
        got_ends[r["key"], r["number"]] += r["n_ends"]
    for kind in ("words", "signs"):
        for r in out[kind]:
            got_lengths[kind, r["key"], r["number"]] += r["n"]
    assert len(uses) > 40 and len(lengths) > 10
    assert got == uses and +got_ends == ends and got_lengths == lengths
    assert [r["doc_id"] for r in out["doc"]] == [i for i, x in enumerate(ODD_TEXTS) if x.strip()]
    for r in out["doc"]:
        f = t.Facts(ODD_TEXTS[r["doc_id"]])
        assert [r["flags"] >> i & 1 for i in range(1, 5)] == [f.missing, f.whole, f.change, f.newline] and r["flags"] >> len(t._FLAGS) == f.mark


def test_shapes_of_all_words_at_once():
    words = [w for x in ODD_TEXTS for w in x.split()] + ["a0", "0a0", "aa--00##11bb", "é1e", "00", "aA"]
    assert t.shapes_of(words) == ([t.shape(w) for w in words], [bool(re.search("[0-9]", w)) for w in words])
    assert t.shapes_of([]) == ([], [])


def test_survey_does_not_take_words_one_by_one(monkeypatch):
    """The work in Python is one step a text, and rows have few columns that are empty."""
    calls, shape = [], t.shape
    monkeypatch.setattr(t, "shape", lambda w: calls.append(w) or shape(w))
    out = surveyed([" ".join(f"w{i}x{j}" for j in range(200)) for i in range(30)])
    assert sum(r["n"] for r in out["word"]) == 6000 and len(calls) <= 2 * 30
    assert len(t._SURVEY) <= 14
