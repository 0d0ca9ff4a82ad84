"""Ids of any kind: null, repeated, strings; and rows that very many repeat."""

import collections
import random

from lodestar.llm import quality, subdedup

WORDS = [f"w{k}" for k in range(400)]


def test_null_ids_of_one_length_fall_into_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(subdedup, "BLOCK_BYTES", (4000, 4000))
    rng = random.Random(1)
    texts = [" ".join(f"{rng.randrange(10**5):05d}" for _ in range(50)) for _ in range(300)]
    texts += texts[:3]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    sizes = collections.Counter()
    for r in docs.selectExpr("pmod(xxhash64(doc_id, cast(text as binary), 1L), 20) as b").collect():
        sizes[r.b] += 1
    assert len(sizes) == 20 and max(sizes.values()) < 60
    got = collections.Counter((r.n_words, r.n_removed) for r in subdedup.remove_repeats(docs).collect())
    assert got == {(50, 50): 6, (50, 0): 297}


def test_rows_that_very_many_repeat_are_parsed_twice(spark):
    one, short, other = " ".join(WORDS[:60]), "a few words", " ".join(["x", *WORDS[10:50], "y"])
    rows = [(7, one)] * 500 + [(None, short)] * 200 + [(None, None)] * 150 + [(8, other), (7, other + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in subdedup.remove_repeats(docs).collect())
    # 40 words of `other` are in `one`; x and y go too, as both of its rows have them.
    assert got == {(7, 60, 60, ""): 500, (None, 3, 0, short): 200, (None, 0, 0, ""): 150, (8, 42, 42, ""): 1, (7, 43, 42, "z"): 1}


def test_quality_takes_ids_of_any_type(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS[:200] if k % 2 else WORDS[200:], k=80)), k % 2) for k in range(160)]
    long_ids = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    kept = {}
    for kind in ("long", "string", "decimal(20,0)"):
        d = long_ids.selectExpr(f"cast(doc_id as {kind}) as doc_id", "text", "quality")
        model = quality.fit(d.select("doc_id", "text"), d.select("doc_id", "quality"))
        found = quality.score(d.select("doc_id", "text"), model)
        assert found.schema["doc_id"].dataType.simpleString() == kind.replace("long", "bigint")
        kept[kind] = {int(r.doc_id) for r in found.collect() if r.kept}
    assert all(len(k ^ {r[0] for r in rows if r[2]}) <= 8 for k in kept.values()) and kept["long"] == kept["decimal(20,0)"]
