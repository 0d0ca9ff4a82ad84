"""The pipeline's stages against plain versions on a small corpus, one input each."""

import collections
import re

import pytest

import corpus_pipeline
from lodestar.llm import mixing, packing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_run_is_its_stages_and_reruns_agree(spark, sf):
    first = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        held[name] = docs
    assert sorted(map(tuple, docs.collect()), key=repr) == first

    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r.doc_id for r in held["quality rules"].collect()}
    p = quality.QualityParams()
    for k, r in source.items():
        n, _, _, _, repeat, _, _ = quality.base_counts(r.text)
        assert k not in kept or not quality.fails_rules(n, repeat, p)
    prints = {k: simhash.fingerprint(source[k].text) & (2**64 - 1) for k in kept}
    low = {k: k for k in prints}
    while True:
        new = {a: min(low[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3) for a in prints}
        if new == low:
            break
        low = new
    one = {r.doc_id: r for r in held["simhash near-dedup"].collect()}
    assert set(one) == set(low.values())
    clean = {r.doc_id: r.text for r in held["pii"].collect()}
    assert set(clean) == set(one) and not any("@mail" in t for t in clean.values())
    copies = collections.Counter(r.doc_id for r in held["mixing"].collect())
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    tokens = collections.Counter()
    for r in docs.collect():
        tokens[r.doc_id] += r.n_tokens
    assert tokens == collections.Counter({k: c * len(WORD.findall(clean[k])) for k, c in copies.items()})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket string, row int, __key string"


def words(seed, n=80):
    return " ".join(f"w{(seed * 7919 + k * 104729) % 1000003}" for k in range(n))


AWKWARD = [
    (None, words(1), "en", "a", 1, 5, "x", 1, "k"), (None, words(2), "en", None, 1, 5, "x", 2, "k"), (None, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 5, "x", 3, "k"), (4, words(3), "en", "b", 1, 5, "x", 4, "k"),
    (4, words(4), "en", "b", 1, 5, "y", 5, "k"), (5, words(3), "de", "c", 1, 5, "x", 6, "k"), (6, words(5), "en", "b", 1, 5, "x", 7, "k"), (6, words(5), "en", "b", 1, 5, "x", 7, "k"), (7, words(6, 60_000), "en", "a", 1, 5, "x", 8, "k"),
    (8, words(7) + " write to ann@mail.example", "en", "a", 1, 5, "x", 9, "k"), (9, "too short", "en", "a", 1, 5, "x", 10, "k"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def made(rows, labels=()):
        path = str(tmp_path_factory.mktemp("sf"))
        spark.createDataFrame(list(rows), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return made


def test_awkward_rows_go_through_all_stages(spark, folder):
    path = folder(AWKWARD, [(4, 1, 0), (None, 1, 1), (6, None, None)])
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, path)
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        kept[name] = rows
    # Short, empty and null texts go; of the copies (4 and 5, 6 twice) one each stays; rows without an id, and the other 4, stay.
    assert sorted((r.doc_id or 0, r.row) for r in kept["quality rules"]) == [(0, 1), (0, 2), (4, 4), (4, 5), (5, 6), (6, 7), (6, 7), (7, 8), (8, 9)]
    assert sorted((r.doc_id or 0, r.row) for r in kept["simhash near-dedup"]) == [(0, 1), (0, 2), (4, 4), (4, 5), (6, 7), (7, 8), (8, 9)]
    assert "ann@mail" not in "".join(r.text for r in kept["pii"]) and len(kept["pii"]) == 7
    assert set(collections.Counter((r.doc_id, r.row) for r in kept["mixing"]).values()) <= {1, 2}
    tokens, want = collections.Counter(), collections.Counter()
    for r in kept["packing"]:
        tokens[r.doc_id] += r.n_tokens
    for r in kept["mixing"]:
        want[r.doc_id] += len(WORD.findall(r.text))
    assert tokens == want


def test_rows_that_share_id_and_text_are_taken_alike_in_reruns(spark):
    rows = [(1, words(9), "en", "a", k, 5, "x", k, "k") for k in range(9)] + [(None, words(10), "en", "b", k, 5, "x", k, "k") for k in range(9)]
    taken = [sorted(((r.doc_id or 0, r.row) for r in mixing.stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), "").collect())) for n in (1, 3, 7)]
    assert taken[0] == taken[1] == taken[2] and taken[0]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_an_empty_table(spark, folder, name):
    path = folder([])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, path).count() == 0


def test_run_on_empty_tables_is_empty(spark, folder):
    assert corpus_pipeline.run(spark, folder([])).count() == 0


def test_packing_stage_packs_repeats_each_for_itself(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, None), (2, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.slot) for r in packing.stage(spark, df, "").collect()) == [(None, 3, 0), (None, 3, 1)]
