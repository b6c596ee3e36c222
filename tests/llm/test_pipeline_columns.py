"""The pipeline's stages on bytes that are no UTF-8 and on columns that bear names of the operators."""

import corpus_pipeline
from chatloom.llm import packing
from chatloom.llm.common import table
from chatloom.llm.queries import tokenizer_path

CLASH = ("removed", "kept", "_doc", "_size", "_copy", "component", "n_words", "partners", "Kept_x", "size", "row", "gone")


def test_stages_keep_columns_with_clashing_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = "concat(substr(text, 1, 300), cast(unhex('FFFE41') as string), substr(text, 301))"
    docs = docs.selectExpr(
        "doc_id", f"case when doc_id % 3 = 0 then {bad} else text end as text", "lang", "source", "n_chars",
        *(f"concat('{c}', doc_id) as `{c}`" for c in CLASH),
    )
    plain = {r.doc_id for r in corpus_pipeline.quality(spark, table(spark, sf_dir, "documents"), sf_dir).collect()}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.landed(stage(spark, frame, sf_dir), "stage")
        assert frame.columns == docs.columns, name
        rows = frame.collect()
        assert rows, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH), name
        if name == "quality rules":
            assert len(plain ^ {r.doc_id for r in rows}) < len(plain) // 10
    assert corpus_pipeline.packing(spark, frame, sf_dir).count() >= frame.count()


def test_packing_takes_bytes_that_are_no_text(spark):
    docs = spark.sql("select 1L doc_id, cast(unhex('41FF42') as string) text union all select 2L, 'A�B'")
    a, b = packing.packed(docs, tokenizer_path()).orderBy("doc_id").collect()
    assert (a.length, a.ids_crc32) == (b.length, b.ids_crc32)
