import duckdb

import corpus_pipeline
from tests.llm.helpers import contamination_rows, rows_of, secret_spans, simhash_rows, sort_rows
from tidyloom.llm import queries
from tidyloom.llm.oracles import oracle_sql

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.collect()
        if k < 4:
            assert docs.columns == columns
    first, second, third, fourth, fifth = kept.values()
    rows = simhash_rows([(r["doc_id"], r["text"]) for r in first])
    assert {r["doc_id"] for r in second} == {i for i, _, c in rows if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contamination_rows([(r["doc_id"], r["text"]) for r in second], items) if r[-1]}
    assert {r["doc_id"] for r in third} == {r["doc_id"] for r in second} - hit
    assert {r["doc_id"] for r in fourth} == {r["doc_id"] for r in third}
    assert not any(secret_spans(r["text"]) for r in fourth)
    assert {r["doc_id"] for r in fifth} == {r["doc_id"] for r in fourth}


def test_no_language_is_rejected(spark):
    docs = spark.createDataFrame([(1, "12 34", "en", "s", 5), (2, None, "en", "s", 0), (3, "hello the world", "en", "s", 15)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [3]


def test_a_text_without_a_leading_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    halves = {r["lang"]: r["text"][:400] for r in docs.where("length(text) > 2000").orderBy("doc_id").collect()}
    assert sorted(halves) == ["de", "en", "es", "fr"]
    mixed = spark.createDataFrame([(-1, " ".join(halves.values()), None, "s", 1600), (-2, halves["de"], None, "s", 400)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.union(mixed), SF)
    assert {r["doc_id"] for r in kept.collect()} & {-1, -2} == {-2}


def test_identified_language_decides_the_sequences(spark):
    rows = [(k, f"word number {k} " * (1 + k % 40), "abc"[k % 3] if k % 7 else None, "s", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2)
    got = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    own = {k: lang for k, _, lang, _, _ in rows}
    assert all(r["lang"] == own[r["doc_id"]] for r in got)
    langs = {}
    for r in got:
        langs.setdefault(r["sequence_id"], set()).add(r["lang"])
    assert {len(x) for x in langs.values()} == {1}
    # The same texts with another language each lie in other sequences.
    other = corpus_pipeline.pack_sequences(spark, docs.replace("a", "b", "lang"), SF).collect()
    place = lambda rows: {(r["doc_id"], r["start"]): (r["sequence_id"], r["offset"]) for r in rows}
    assert place(other) != place(got)
    assert sum(r["length"] for r in other) == sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())


def test_oracles_run(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        order = ", ".join(sorted(want.columns))
        want = con.sql(f"select {order} from ({sql})").fetchall()
        assert rows_of(got, *sorted(got.columns)) == sort_rows(want)
