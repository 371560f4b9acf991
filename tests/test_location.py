"""Location inside a document's row against the join of two tables."""

import random

from pyspark.sql import functions as F

from tessellex.operators import chunking, locate
from tessellex.sources import pages

LISTS = (
    "doc_id bigint, page string, sections array<struct<section_id:int,section_number:string,section_title:string>>, "
    "pages array<struct<page_no:int,text:string>>"
)


def some_document(rng, i):
    words = "penalty entry register citizenship passport officer appeal foreigner".split()
    title = lambda: rng.choice([None, "", " ".join(rng.choices(words, k=3)).title()])
    number = lambda: rng.choice([None, "N/A", " n/a ", "3", "12A", "Section 4", "7.", "1", "2"])
    line = lambda: rng.choice(
        [f"{rng.randint(1, 12)}. Of {rng.choice(words)}", f"see Section {rng.choice(['3', '4', '12a'])} there", " ".join(rng.choices(words, k=5)),
         "ARRANGEMENT OF SECTIONS", "FORM I", "नागरिकता " * 12]
    )
    sections = [(n, number(), title()) for n in range(rng.randint(0, 6))]
    return i, "kept", sections, [(p + 1, "\n".join(line() for _ in range(rng.randint(1, 6)))) for p in range(rng.randint(0, 5)) if rng.random() < 0.9]


def test_same_pages_as_the_join(spark):
    rng = random.Random(11)
    rows = [some_document(rng, i) for i in range(300)] + [(900, None, None, [(1, "x")]), (901, None, [(0, "3", "Penalty")], [])]
    docs = spark.createDataFrame(rows, LISTS)
    sections = docs.select("doc_id", F.inline("sections"))
    found = locate.locate_in_documents(docs.drop("page"))
    joined = locate.locate_pages(sections, docs.select("doc_id", F.inline("pages")))
    columns = ["doc_id", "section_id", "section_number", "section_title", "page"]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(found.select(columns).collect(), key=key) == sorted(joined.select(columns).collect(), key=key)
    texts = {(r[0], n): t for r in rows for n, t in r[3]}
    assert all(r["page_text"] == texts.get((r["doc_id"], r["page"])) for r in found.collect())
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_lists_are_those_of_the_tables(spark):
    texts = ["1. One.— a\n2. Two.— b\fpage\f\f 3. Three.— c", "no header", "l\n" * 130, "CHAPTER I\n4A. Title\nx", " \f "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    listed = docs.select("doc_id", F.inline(chunking.section_list(F.col("text")))).where("doc_id < 4").collect()
    rows = chunking.section_chunks(docs).select("doc_id", "chunk_index", "section_number", "section_title").collect()
    assert sorted(map(tuple, listed), key=str) == sorted(map(tuple, rows), key=str)
    listed = docs.select("doc_id", F.inline(pages.page_list(F.col("text")))).collect()
    assert sorted(map(tuple, listed)) == sorted(map(tuple, pages.split_pages(docs).collect()))


def test_a_thousand_sections(spark):
    text = "".join(f"{n}. Title of part {n}.— words of the officer\n" + ("\f" if n % 10 == 0 else "") for n in range(1, 1201))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    lists = docs.select("doc_id", chunking.section_list(F.col("text")).alias("sections"), pages.page_list(F.col("text")).alias("pages"))
    found = {r["section_number"]: r["page"] for r in locate.locate_in_documents(lists).collect()}
    assert found == {str(n): (n - 1) // 10 + 1 for n in range(1, 1201)}
