import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelot.llm import copies as c
from tidelot.session import materialise, scratch_dir, table

SF = "/root/testdata/sf0.01"


def entries_of(texts):
    return [tuple(r.values()) for r in c.Anchors().table([(h, x.split()) for h, x in texts.items()]).to_pylist()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "bucket bigint, follows binary, `left` bigint, looked_up boolean, text_hash bigint")


def first_that_goes_on(rows):
    """The definition, over all pairs of a bucket."""
    out = set()
    ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[4]))
    for i, (bucket, follows, left, looked_up, text) in enumerate(ordered):
        if looked_up:
            hit = next((r[4] for r in ordered[i + 1 :] if r[0] == bucket and r[1].startswith(follows) and r[2] >= left + c.GOES_ON), None)
            if hit not in (None, text):
                out.add((text, hit))
    return out


@pytest.mark.parametrize("parts", ["1", "3", "17"])
def test_neighbours_do_not_depend_on_where_buckets_are_split(spark, parts):
    rng = random.Random(2)
    rows = []
    for i in range(400):  # one bucket holds most rows, with many of the same length
        bucket = 7 if rng.random() < 0.8 else rng.randint(1, 9)
        n = rng.randint(0, 3)
        rows.append((bucket, bytes(rng.choice([1, 1, 1, 2]) for _ in range(4 * n)), 8 + 16 * n + rng.randint(0, 15), rng.random() < 0.7, i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {tuple(r) for r in c.neighbours(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = first_that_goes_on(rows)
    assert len(want) > 50 and got == want


def test_no_entries(spark):
    assert c.neighbours(frame(spark, [])).count() == 0
    assert not entries_of({1: "", 2: "w " * 12, 3: "w " * 500}) and not entries_of({})


@pytest.mark.skipif(not Path(SF).is_dir(), reason="the test tables are not here")
def test_recall_of_planted_copies(spark):
    """Copies of whole texts cut anywhere behind the first words meet their originals, however much they lost."""
    rng = random.Random(1)
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").filter("text is not null").collect()}
    planted = {}
    for i, x in list(texts.items()):
        cut = x[: int(len(x) * rng.uniform(0.1, 0.95))]
        if len(x.split()) >= 40 and len(cut.split()) >= 15:
            planted[-i] = cut
    docs = spark.createDataFrame(list((texts | planted).items()), "doc_id bigint, text string")
    rows = entries_of(texts | planted)
    found = {r["text_hash"] for r in c.early_ends(docs, docs.select("doc_id", F.col("doc_id").alias("text_hash")), frame(spark, rows)).collect()}
    assert len(planted) > 500
    assert len(found & set(planted)) / len(planted) >= 0.95
    whole = {r["doc_id"] for r in table(spark, SF, "documents").join(docs.select("doc_id"), "doc_id").collect()}
    assert len(found & whole) <= 0.02 * len(whole)  # the table has cut copies of its own


def test_a_copy_with_edits_still_meets_its_original():
    rng, a, hits = random.Random(4), c.Anchors(), 0
    for k in range(300):
        full = [f"w{k}x{i}" for i in range(200)]
        cut = [w if rng.random() > 0.005 else "edit" for w in full[:120]]
        both = entries_of({1: " ".join(cut), 2: " ".join(full)})
        hits += (1, 2) in first_that_goes_on(both) and c.compare(" ".join(cut), " ".join(full), a)
    assert hits / 300 > 0.8


def test_compare():
    a = c.Anchors()
    words = [f"w{i}" for i in range(100)]
    text = " ".join
    assert c.compare(text(words[:85]), text(words), a) and c.compare(text(words[:20]), text(words), a)
    assert c.compare(text(words[:50]) + " w5", text(words), a)  # ends inside a word
    assert not c.compare(text(words), text(words), a)
    assert not c.compare(text(words[:95]), text(words), a)  # five words are too few
    assert not c.compare(text(words), text(words) + "\nReviewed-by: A B C D E F G", a)  # a trailer is no content
    assert not c.compare(text(words[15:]), text(words), a)  # lacks its start, not its end
    assert not c.compare(text(words[:60] + ["x"] * 10), text(words), a)  # ends otherwise
    assert not c.compare("", text(words), a) and not c.compare("one", "one two", a)


def test_very_long_texts_have_short_lists():
    rows = entries_of({1: " ".join(f"w{i}" for i in range(200_000))})
    assert rows and max(len(r[1]) for r in rows) < 1200


def with_shared_paragraphs():
    """Originals that share long paragraphs, and copies that end inside of these: the nearest that goes on is mostly another's."""
    rng = random.Random(6)
    shared = [[f"s{k}x{i}" for i in range(60)] for k in range(3)]
    texts, copies = {}, set()
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(rng.randint(10, 45))]
        texts[i] = " ".join([*own, *shared[i % 3], *(f"t{i}x{j}" for j in range(20))])
        if i % 2:
            cut = [*own, *shared[i % 3][: rng.randint(30, 58)]]
            if i % 4 == 1:
                cut[-rng.randint(8, 20)] = "edit"
            texts[1000 + i] = " ".join(cut)
            copies.add(1000 + i)
    return texts, copies


def test_all_members_of_a_bucket_are_partners(spark):
    texts, copies = with_shared_paragraphs()
    a, rows = c.Anchors(), entries_of(texts)
    alike = {(x, y) for x in texts for y in texts if x != y and c.compare(texts[x], texts[y], a)}
    members = {}
    for r in rows:
        members.setdefault(r[0], set()).add(r[4])
    in_a_bucket = {(r[4], y) for r in rows if r[3] for y in members[r[0]]}
    want = {x for x, y in alike & in_a_bucket}
    assert len(want) > 35 and want <= copies
    first = first_that_goes_on(rows)
    assert len({x for x, y in alike & first}) < 0.7 * len(want)  # what the first continuations alone would give
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["text_hash"] for r in c.early_ends(docs, docs.select("doc_id", F.col("doc_id").alias("text_hash")), frame(spark, rows)).collect()}
    assert want <= found <= {x for x, y in alike}


@pytest.mark.parametrize("few", [0, 4])
def test_others_leave_out_no_pair_that_compares(spark, monkeypatch, few):
    monkeypatch.setattr(c, "FEW", few)
    rng, texts = random.Random(8), {}
    for i in range(25):
        full = [f"w{rng.randint(0, 12 if i % 5 == 0 else 400)}" for _ in range(rng.randint(8, 160))]
        texts[i] = " ".join(full)
        for k in range(4):
            cut = [w if rng.random() > 0.01 * k else "edit" for w in full[: rng.randint(3, len(full))]]
            texts[100 * (k + 1) + i] = " ".join(cut) + rng.choice(["", " w", " cut off"])
    a = c.Anchors()
    alike = {(x, y) for x in texts for y in texts if x != y and c.compare(texts[x], texts[y], a)}
    both = spark.createDataFrame(list(texts.items()), "text_hash bigint, text string")
    got = [tuple(r) for r in c.others(both, both).collect()]
    assert len(alike) > 60 and alike <= set(got) and len(got) == len(set(got))
    assert len(got) < 0.25 * len(texts) ** 2


def test_scratch_of_others_is_a_few_bytes_a_shingle(spark):
    """Texts of their own that end alike: nothing is written for each pair of text and shingle but an entry of an array."""
    rng, shared = random.Random(9), [f"s{i}" for i in range(40)]
    texts = {i: [*(f"o{i}x{j}" for j in range(150)), *shared[: rng.choice([25, 30, 40])]] for i in range(1500)}
    both = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "text_hash bigint, text string")
    place = Path(scratch_dir(spark, "x").removeprefix("file:")).parent
    size = lambda: sum(p.stat().st_size for p in place.rglob("*.parquet"))
    before = size()
    assert c.others(both, both).count() == 0  # all hold the last shingles of others, and too few of the rest
    assert size() - before < 8 * sum(map(len, texts.values()))


@pytest.mark.parametrize("bits", [2, 9, 16])
def test_others_of_short_texts_and_many_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(c, "_parts_of", lambda _: bits)
    words = [f"w{i}" for i in range(60)]
    texts = dict(enumerate(["", "one", "a b c d", "a b c d e", "a b c d e f", " ".join(words), " ".join(words[:30]), " ".join(["edit", *words[1:40]]), "w " * 90, "w " * 50]))
    both = spark.createDataFrame(list(texts.items()), "text_hash bigint, text string")
    a = c.Anchors()
    got = {tuple(r) for r in c.others(both, both).collect()}
    assert {(6, 5), (7, 5)} <= {(x, y) for x in texts for y in texts if x != y and c.compare(texts[x], texts[y], a)} <= got
    assert c.others(both.limit(0), both.limit(0)).count() == 0


def test_only_texts_of_pairs_move(spark):
    both = spark.range(3000).selectExpr("id as text_hash", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', id, 'x', i))) as text")
    found, pairs = materialise(both, "texts"), materialise(both.limit(5).selectExpr("text_hash", "text_hash + 1 as other"), "pairs")
    plan = c._verified(pairs, found)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan  # the longer texts, too, are cut to those of pairs before they are sent on
    assert c._verified(pairs, found).count() == 0


def test_words_are_those_of_str_split():
    odd = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert c.split_words(pa.array(odd))[0].tolist() == [len(x.split()) for x in odd]
    texts = ["", " ", "one", " two  words\n", "\x1c\u0085", "a\x1cb c \r\n d", "", "w " * 20]
    for some in (texts, texts[:2], []):
        n, ids, words = c.split_words(pa.array([*some, "x"], pa.string()).slice(0, len(some)))
        assert n.tolist() == [len(x.split()) for x in some]
        assert [words[i].as_py() for i in ids] == [w for x in some for w in x.split()]
    assert list(c.slices(pa.array(["abc", "", "a" * 20, "b", "c", "d"]), 4, 2)) == [(0, 2), (2, 3), (3, 5), (5, 6)]
