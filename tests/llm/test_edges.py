"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from patchloom.llm import decontam, embeddings, langid, lmscore, minhash, packing, pages, pii, sharding, toxicity
from patchloom.llm.queries import tokenizer_path

CLASHES = ["n", "rep", "bits", "bands", "key", "label", "score", "size", "node", "shard", "hash", "row", "toxic", "_id", "_gone", "item_id", "length", "bin", "host", "paths", "kind", "a", "b"]
LONG = ("lorem ipsum dolor " * 20_000) + "idiot"
TEXTS = [(1, "the cat sat on the mat and looked at you"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, LONG), (7, LONG + " more"), (None, "a text without an id"), (None, None), (8, "the cat sat on the mat and looked at you"), (8, "the cat sat on the mat and looked at you"), (9, "\u0000 ퟿ é 日本 🔒"), (10, "12345 ?!")]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None, *["x"] * len(CLASHES)) for k, (i, t) in enumerate(rows)], KIND)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(1, 1, 0), (6, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0)]
BENCH = [(1, "the cat sat on the mat and looked"), (2, None), (3, ""), (None, "zzz yyy xxx www vvv uuu")]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "pii": lambda s, d, e: pii.find(d),
    "minhash": lambda s, d, e: minhash.near_duplicates(d),
    "sharding": lambda s, d, e: sharding.shard_documents(d, 5),
    "lmscore": lambda s, d, e: lmscore.score_documents(d),
    "langid": lambda s, d, e: langid.identify(d, langid.fit(d)),
    "toxicity": lambda s, d, e: toxicity.score(d, toxicity.fit(d, labels(s, [] if e else LABELS))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, table(spark, TEXTS), False).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in TEXTS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, table(spark, []), True).collect() == []


def test_near_duplicates(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, TEXTS)).collect()}
    assert {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 1, None, True), (None, 0, None, True), (1, 6, 1, True), (8, 6, 1, False)} <= got
    assert {r[2] for r in got if r[0] in (6, 7)} in ({6}, {6, 7})


def test_languages(spark):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(table(spark, TEXTS), langid.fit(table(spark, TEXTS))).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (10, "und")} <= got


def test_packing(spark):
    got = packing.pack_documents(table(spark, TEXTS), tokenizer_path("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got[got.doc_id.isin([2, 3, 4])].length.tolist() == [1, 1, 1]
    assert packing.pack_documents(table(spark, []), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_leaks(spark):
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(table(spark, TEXTS), bench(spark, BENCH)).collect()}
    assert got == {(1, 1), (8, 1)}
    assert decontam.find_leaks(table(spark, []), bench(spark, BENCH)).collect() == []
    assert decontam.find_leaks(table(spark, TEXTS), bench(spark, [])).collect() == []
    assert decontam.find_leaks(table(spark, TEXTS), bench(spark, BENCH[1:3])).collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h/x", ""), (None, "x", "<p>a</p>"), (3, "http://h/x", "<" * 5000), (3, "http://h/x", "<div>" * 3000 + "deep")]
    got = pages.extract_pages(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, paths string")).collect()
    assert len(got) == 5 and {(r.page_id, r.text) for r in got} >= {(1, ""), (2, ""), (None, "a"), (3, "deep")}
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_empty_vectors(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def write(spark, folder, rows, labelled, items):
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels(spark, labelled).write.parquet(f"{folder}/labels.parquet")
    bench(spark, items).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    d = write(spark, str(tmp_path), TEXTS, LABELS, BENCH)
    docs = table(spark, TEXTS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert {None, 1, 2, 3, 4, 5, 9, 10} <= kept and 8 not in kept
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, d).collect()} == {None, 2, 3, 4, 5, 6, 7, 9, 10}


def test_empty_pipeline(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, str(tmp_path), [], [], [])).collect() == []


def test_pipeline_against_its_operators(spark):
    """Stage by stage on real rows: what each operator says of a document is what becomes of it."""
    d = "/root/testdata/sf0.001"
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    grammar = toxicity.fit(read("documents"), read("labels"))
    docs = {i: t for i, t in docs.items() if grammar.score(t) < 0.3}
    words = lambda t: t.encode().lower().split()
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, t in docs.items() if (w := words(t))}
    up = {i: i for i in docs}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    docs = {i: t for i, t in docs.items() if up[i] == i}
    items = [r.text for r in read("benchmark").collect()]
    docs = {i: pii.masked(t) for i, t in docs.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, d).toPandas()
    assert set(got.doc_id) == set(docs)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, t in docs.items():
        assert got[got.doc_id == i].length.sum() == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
