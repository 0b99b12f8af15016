from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near
from test_packing import check_pieces

import corpus_pipeline
from tidemark.llm.decontamination import EDIT_PERCENT
from tidemark.llm.quality_rules import fit_field, judge


def distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, row[j - 1] + (a != b), new[j - 1] + 1))
        row = new
    return min(row)


def test_stages_against_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    items = spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()
    columns = docs.columns
    rows, results = {}, {"": docs}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, data_dir)
        results[name] = rows[name] = out.collect()
        if name != "packing":
            assert out.columns == columns
            before = spark.createDataFrame(rows[name], docs.schema)
    field = fit_field(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))
    good = {r.doc_id for r in judge(docs, field).collect() if r.kept}
    assert {r.doc_id for r in rows["quality_rules"]} == good
    lines = brute_lines([(r.doc_id, r.text) for r in rows["quality_rules"]], 40, 5)
    assert sorted((r.doc_id, r.text) for r in rows["line_dedup"]) == [(i, t) for i, _, _, t in lines]
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"])
    keepers = {r[0] for r in brute_near([(r.doc_id, r.text) for r in rows["line_dedup"]]) if r[3]}
    assert {r.doc_id for r in rows["near_dedup"]} == keepers
    words = lambda t: t.encode().lower().split()
    clean = set()
    for r in rows["near_dedup"]:
        text = words(r.text)
        known = set(text)
        close = [i for i in items if len(known & set(words(i.text))) >= len(set(words(i.text))) - EDIT_PERCENT * len(words(i.text)) // 100]
        if not any(distance_within(words(i.text), text) <= EDIT_PERCENT * len(words(i.text)) // 100 for i in close):
            clean.add(r.doc_id)
    assert {r.doc_id for r in rows["decontamination"]} == clean
    check_pieces([(r.doc_id, r.text, r.source) for r in rows["decontamination"]], rows["packing"], 2048)
    # which place a document takes in its queue depends on the partitions; that all stages apply does not
    check_pieces([(r.doc_id, r.text, r.source) for r in rows["decontamination"]], corpus_pipeline.run(spark, data_dir).collect(), 2048)


def test_stages_take_odd_rows(spark, data_dir):
    """Null ids and texts, repeated rows, clashing columns and empty tables: each stage keeps the columns of documents."""
    good = next(r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect() if r.text and len(r.text) > 1500)
    rows = [(1, good, "en", "a", 1, "x"), (None, good, "en", None, 1, "x"), (2, None, None, "a", None, "x"), (3, "", "en", "b", 0, "x"), (1, good, "en", "a", 1, "x"), (4, good + " more", "en", "b", 2, "x")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, __id string"
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, data_dir)
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
            got = out.collect()
            assert not got or frame is docs
        if name == "near_dedup":
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in stage(spark, docs, data_dir).collect()) == [-1, 1, 1, 2, 3]
