"""What must stay small or happen once however large the input is."""

from tessellex.operators import chunking, documents


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def statute_rows(spark):
    rows = [
        (1, "a/The_Entry_Act.pdf", "The Entry Act, 1950\n1. Title.— This may be called so.\n2. Terms.— The Foreigners Act, 1946 applies."),
        (2, "a/plain_notice.txt", "notice without any act\n3. Penalty.— The Passports Act, 1967 applies."),
        (3, "a/no_act.txt", "nothing here"),
        (4, "a/blank.txt", " "),
    ]
    return spark.createDataFrame(rows, "doc_id long, source_file string, text string")


def test_titles_without_the_other_metadata(spark):
    docs = statute_rows(spark)
    full = documents.describe_documents(docs).select("doc_id", "text", "title", "year")
    light = documents.title_documents(docs)
    assert sorted(light.collect()) == sorted(full.collect())
    assert "punishable" not in plan(light)


def test_windows_are_computed_once(spark):
    docs = statute_rows(spark).select("doc_id", "text")
    assert plan(chunking.sliding_chunks(docs, size=30, overlap=10)).count("ArrowEvalPython") == 1


def test_structural_chunks_extract_only_what_is_read(spark):
    df = chunking.structural_chunks(documents.title_documents(statute_rows(spark)), size=60, overlap=10)
    assert "punishable" not in plan(df.select("doc_id", "title"))
    assert [r.act_year for r in df.where("doc_id = 1 AND start_char = 0").collect()] == [1950]


def test_exchanges_have_as_many_tasks_as_the_measured_input_asks_for(spark, monkeypatch):
    from tessellex.operators import bm25, sizing

    monkeypatch.setattr(sizing, "TASK_CHARS", 100)
    chunks = spark.range(300).selectExpr("id AS chunk_id", "concat('alpha beta w', id) AS text")
    asked = spark.createDataFrame([(1, "alpha w7"), (2, "beta")], "query_id long, text string")
    assert sizing.text_size(chunks)[0] == 300
    wanted = sizing.tasks_for(spark, chars=sizing.text_size(chunks)[1])
    assert wanted > 40
    assert f", {wanted}), REPARTITION_BY_NUM" in plan(bm25.search_corpus(chunks, asked, 2))
    assert f", {wanted}), REPARTITION_BY_NUM" in plan(bm25.term_frequencies(chunks))
    monkeypatch.setattr(sizing, "TASK_ROWS", 10)
    found = bm25.search_corpus(chunks, asked, 2)
    assert ", 60), REPARTITION_BY_NUM" in plan(found)  # 300 chunks, two questions
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect())[:2] == [(1, 1, 7), (1, 2, 0)]


def test_section_size_counts_the_sections(spark):
    docs = statute_rows(spark).select("doc_id", "text").where("doc_id < 4")
    assert chunking.section_size(docs)[0] == chunking.section_chunks(docs).count()


def test_filter_of_an_index_search_moves_no_scores(spark, tmp_path, monkeypatch):
    from tessellex.operators import bm25, sizing

    chunks = spark.range(60).selectExpr("id AS chunk_id", "concat('alpha beta w', id) AS text")
    index = bm25.write_index(chunks, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha w7"), (2, "beta")], "query_id long, text string")
    monkeypatch.setattr(sizing, "TASK_ROWS", 3)
    found = bm25.search_index(index, asked, 2, allowed=chunks.where("chunk_id > 7").select("chunk_id"))
    assert plan(found).count("hashpartitioning(chunk_id") == 2  # postings and filter, dealt alike
    assert plan(found).count(", 41), REPARTITION_BY_NUM") == 2  # 121 postings
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in found.collect()) == [(1, 1, 8), (1, 2, 9), (2, 1, 8), (2, 2, 9)]


def test_windows_hold_one_document_as_python_objects(monkeypatch):
    import pyarrow as pa

    texts = pa.array([["a b c d " * 20, ""], [""]])
    found = chunking._window_udf(30, 10, False).func(texts)
    assert isinstance(found, pa.Array) and found.type == pa.list_(pa.list_(pa.int32()))
    assert found.to_pylist() == [[chunking.window_offsets("a b c d " * 20, 30, 10, False), []], [[]]]


def test_enriched_chunks_extract_only_the_metadata_they_take(spark):
    from tessellex import fixed_values as fv
    from tessellex.plans import extraction

    docs = statute_rows(spark)
    unread = (fv.SCHEDULE_REFERENCE, fv.CROSS_REFERENCE, fv.DEFINITION_DASH)
    rich = extraction.rich_chunks(docs).select("doc_id", "act_name", "keywords", "authorities", "penalty_type", "tags")
    assert not [p for p in unread if p in rich._jdf.queryExecution().optimizedPlan().toString()]
    whole = documents.extract_documents(docs)
    assert all(p in whole._jdf.queryExecution().optimizedPlan().toString() for p in unread)
    found = {r.doc_id: (r.act_name, r.act_year, r.total_sections, len(r.cross_references)) for r in whole.collect()}
    assert found[1] == ("Entry Act", 1950, 3, 0) and found[3] == (None, None, 1, 0) and found[4] == (None, None, 0, 0)
