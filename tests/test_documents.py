"""Files, pages, chunking, storage, streams, sessions and evaluation."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessellex.operators import chunking, embedding, evaluation, sessions, sizing, validation
from tessellex.sources import files, pages, sinks
from tessellex.streaming import ingest
from tessellex.streaming.sessions import session_memory, session_messages

STATUTE = (
    "The Visa Act, 1950\nCHAPTER I\n\n1. Short title.— This is the Act.\n2. Penalty.— Whoever enters is liable to a fine of Rs. 5,000.\n"
    "Provided that minors are exempt.\n"
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_section_chunks_offsets_and_chapter(spark):
    rows = chunking.section_chunks(docs(spark, STATUTE, "no header", " ")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.section_number) for r in rows] == [(0, "1"), (0, "2"), (1, None)]
    for r in rows:
        assert r.text[r.start_char : r.end_char].strip() == r.content
    assert rows[0].chapter_number == "I" and rows[0].chapter_name is None
    assert rows[1].chapter_name == "1. Short title.— This is the Act."


def brute_windows(text, size, overlap, min_advance=False):
    """By patterns: a window is the longest run before a line end, else before a blank, else it is full."""
    starts, out = [0] if text else [], []
    for start in starts:
        body = text[start : start + size]
        whole = start + size >= len(text)
        run = not whole and (re.match(r"(?s)(.+)\n", body) or re.match(r"(?s)(.+) ", body))
        width = len(run[1]) if run else len(body)
        out += [(start, start + width)] if re.search(r"\S", body[:width]) else []
        step = width - overlap
        starts += [] if whole else [start + (step if step > 0 else width if min_advance else 1)]
    return out


def test_sliding_chunks(spark):
    texts = ["word " * 50, "a\n" + "x" * 90, "ab cd\nef " * 20, "short", "y" * 75]
    got = {}
    for r in chunking.sliding_chunks(docs(spark, *texts), size=30, overlap=10).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
        assert r.content == r.text[r.start_char : r.end_char]
    assert got == {i: (brute_windows(t, 30, 10) if len(t) > 30 else [(0, len(t))]) for i, t in enumerate(texts)}
    quick = chunking.sliding_chunks(docs(spark, texts[1]), size=30, overlap=10, min_advance=True).collect()
    assert [(r.start_char, r.end_char) for r in quick] == brute_windows(texts[1], 30, 10, True)
    with pytest.raises(ValueError):
        chunking.sliding_chunks(docs(spark, "x"), size=10, overlap=10)


def test_structural_segments_keep_everything_but_blank_text(spark):
    texts = ["\nCHAPTER I\nx", "pre\n1. Aa\n\nSection 2 b", " \nSection 1", STATUTE]
    rows = chunking.structural_segments(docs(spark, *texts)).orderBy("doc_id", "start_char").collect()
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        at = 0
        for r in mine:
            assert text[at : r.start_char].strip() == "" and text[r.start_char : r.end_char] == r.segment
            at = r.end_char
        assert text[at:].strip() == ""
    assert [r.segment for r in rows if r.doc_id == 2] == [" ", "Section 1"]
    assert [r.segment for r in rows if r.doc_id == 0] == ["CHAPTER I\nx"]


def test_page_split(spark):
    text = "\n".join(str(i) for i in range(130)) + "\n"
    rows = pages.split_pages(docs(spark, text, "a\f \fb")).orderBy("doc_id", "page_no").collect()
    assert [(r.doc_id, r.page_no) for r in rows] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 3)]
    assert rows[2].text == "\n".join(str(i) for i in range(120, 130))


def test_page_merge_rules(spark):
    long = "x" * 40
    rows = [
        (1, 1, 1, long), (1, 2, 1, "s"), (1, 2, 2, "two"), (1, 3, 3, "ocr"),  # short page: passes 2 and 3 are used
        (2, 1, 1, long), (2, 2, 2, "unused"), (2, 2, 3, "unused"),  # pass 1 complete
        (3, 1, 3, "only ocr"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, pass int, text string")
    got = {(r.doc_id, r.page_no): r.text for r in pages.merge_extracts(df).collect()}
    assert got == {(1, 1): long, (1, 2): "two", (1, 3): "ocr", (2, 1): long, (3, 1): "only ocr"}
    joined = {r.doc_id: r.text for r in pages.assemble_text(pages.merge_extracts(df)).collect()}
    assert joined[1] == f"{long}\ftwo\focr"


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text(STATUTE)
    (root / "sub" / "b.TEXT").write_bytes("caf\xe9 Act\r\nline".encode("latin-1"))
    (root / "c.html").write_text("<p>no</p>")
    (root / "blank.txt").write_text("  \n")
    return root


def test_scan_decode_status(spark, folder):
    found = files.scan_corpus(spark, str(folder))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.txt", "b.TEXT", "blank.txt"]
    texts = {r.source_file.rsplit("/", 1)[1]: r.text for r in files.text_documents(found).collect()}
    assert texts["b.TEXT"] == "café Act\nline"
    states = ingest.file_status(found)
    m = sinks.ingestion_metrics(states, spark.createDataFrame([([1.0],)], "embedding array<double>")).first()
    assert (m.total_files_found, m.files_processed, m.files_failed, m.total_vectors_indexed) == (3, 2, 1, 1)
    assert [r.error for r in sinks.ingestion_errors(states).collect()] == ["Failed to ingest 'blank.txt': extracted text is empty"]


def test_batch_ingest_equals_stream_and_repeats_are_harmless(spark, folder, tmp_path):
    batch, stream = str(tmp_path / "batch"), str(tmp_path / "stream")
    assert not sinks.is_indexed(spark, batch)
    stored = ingest.ensure_indexed(spark, str(folder), batch)
    assert stored.count() == 3 and sinks.is_indexed(spark, batch)
    ingest.ingest_folder(spark, str(folder), batch)
    pick = lambda df: sorted((r.chunk_id, r.content, r.section_number) for r in df.collect())
    want = pick(files.chunk_table(spark, batch))
    assert len(want) == 3
    ingest.ingest_stream(spark, str(folder), stream, str(tmp_path / "cp")).awaitTermination(120)
    assert pick(files.chunk_table(spark, stream)) == want
    (folder / "d.txt").write_text("3. More.— New text here.")
    ingest.ingest_stream(spark, str(folder), stream, str(tmp_path / "cp")).awaitTermination(120)
    assert len(pick(files.chunk_table(spark, stream))) == 4
    assert ingest.ingest_folder(spark, str(folder), str(tmp_path / "new"), recreate=True) == 4


def test_embedding_failures_are_rows(spark):
    def broken(texts):
        raise RuntimeError("quota")

    rows = embedding.embed(docs(spark, "a b", "c"), broken).collect()
    assert all(r.embedding is None and r.embed_error == "RuntimeError: quota" for r in rows)
    good = embedding.embed(docs(spark, "a b", ""), embedding.hashing_embedder(8)).orderBy("doc_id").collect()
    assert sum(x * x for x in good[0].embedding) == pytest.approx(1.0, abs=1e-6)
    assert sum(good[1].embedding) == 0


def test_upsert_twice_is_upsert_once_and_deletes(spark):
    schema = "chunk_id int, legal_domain string, embedding array<double>"
    old = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], schema)
    new = spark.createDataFrame([(2, "c", [2.0]), (3, "d", None), (4, "e", [1.0])], schema)
    pick = lambda df: sorted((r.chunk_id, r.legal_domain) for r in df.collect())
    once = sinks.upsert(old, new)
    assert pick(once) == pick(sinks.upsert(once, new)) == [(1, "a"), (2, "c"), (4, "e")]
    assert pick(sinks.delete_where(once, {"legal_domain": "c"})) == [(1, "a"), (4, "e")]
    assert sinks.delete_where(once, {}) is once


def test_history_is_counted_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(sessions, "BUCKET", 4)
    rows = [(c, t * 3, "user", f"m{t}") for c in (1, 2) for t in range(11)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.n_prior, r.has_history) for r in sessions.history_frame(conv).collect())
    assert got == [(c, t * 3, t, t > 0) for c in (1, 2) for t in range(11)]


def test_chat_export_is_json(spark):
    conv = spark.createDataFrame([(1, 0, "user", 'a "q"'), (1, 1, "assistant", "é")], "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(1, 1, 0.5, True, ["x"])], "conv_id long, turn long, confidence_score double, has_penalty boolean, citations array<string>")
    lines = sessions.export_chat(conv, extra).orderBy("turn").collect()
    data = json.loads("".join(r.line for r in lines))
    assert [m["content"] for m in data] == ['a "q"', "é"] and data[1]["citations"] == ["x"]


def test_session_state_keeps_a_bounded_history(spark, tmp_path):
    conv = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(6)], "conv_id long, turn long, role string, text string")
    conv.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(conv.schema).parquet(str(tmp_path / "in"))
    q = (
        session_memory(stream, keep=2).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("turn").collect()
    assert [r.n_prior for r in rows] == list(range(6)) and rows[5].history == ["user: m3", "user: m4"]


def test_session_stream_gives_the_whole_history(spark, tmp_path):
    conv = spark.createDataFrame([(c, t, "user", f"m{c}.{t}") for c in (1, 2) for t in range(30)], "conv_id long, turn long, role string, text string")
    for half in (conv.where("turn < 25"), conv.where("turn >= 25")):
        half.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(conv.schema).parquet(str(tmp_path / "in"))
        q = (
            session_messages(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
    rows = sessions.full_history(spark.read.parquet(str(tmp_path / "out"))).where("conv_id = 2 and n_prior = 29").orderBy("position").collect()
    assert [r.text for r in rows] == [f"m2.{t}" for t in range(29)] and rows[0].ask_turn == 29


def test_history_of_every_question(spark):
    conv = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)], "conv_id long, turn long, role string, text string")
    rows = sessions.history_messages(conv, sessions.all_questions(conv)).collect()
    assert sorted((r.ask_turn, r.turn) for r in rows) == [(a, t) for a in (2, 4, 6) for t in range(a)]


def test_metrics(spark):
    array = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(evaluation.recall(array("5", "21"), array("21 ", "7"))) == 0.5
    assert get(evaluation.recall(array(), array())) == 1.0
    assert get(evaluation.precision(array(), array())) == 0.0
    faith = evaluation.faithfulness(F.lit("The visa officer decides everything. Unrelated nonsense sentence!"), array("the visa officer decides"))
    assert get(faith) == 0.5
    assert get(evaluation.groundedness(F.lit("It does not contain sufficient information."), F.lit(0), array(), F.lit(0.0))) == 1.0
    assert get(evaluation.hallucination(F.lit(0.92))) == 0.08


def test_report_markdown_is_written_in_order(spark, tmp_path):
    result = spark.createDataFrame(
        [("s1", ["5"], 1.0, 0.5, 0.9, 0.9, 0.1, 1.0, 0.2)],
        "sample_id string, retrieved array<string>, retrieval_recall double, retrieval_precision double, faithfulness double, "
        "groundedness double, hallucination_rate double, citation_accuracy double, latency_seconds double",
    )
    summary = evaluation.report(result)
    rows = {r.metric: r.status for r in evaluation.report_rows(summary).collect()}
    assert rows["Retrieval Precision"] == "FAIL" and rows["Groundedness"] == "PASS"
    sinks.write_lines(evaluation.report_markdown(summary, result), ["part", "sample_id", "line_no"], str(tmp_path / "md"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.startswith("# Statutory") and text.index("Mean Latency") < text.index("Sample ID: `s1`")
    empty = evaluation.report(result.where("false")).first()
    assert empty.total_samples == 0 and empty.mean_recall == 0.0


def test_validation(spark):
    df = spark.createDataFrame([(" ", 2000), ("a", 1900), ("b", None)], "source_file string, year int")
    valid, rejected = validation.split_valid(df, validation.document_rules())
    assert valid.count() == 1 and {r.reason for r in rejected.collect()} == {"source_file is blank", "year outside 1947..2100"}
    with pytest.raises(ValueError):
        validation.check_retrieval_sizes(2, 2, 5)


def test_size_check(spark):
    df = docs(spark, "x" * 100)
    assert sizing.is_small(df, F.length("text")) and not sizing.is_small(df, F.length("text"), limit=50)
