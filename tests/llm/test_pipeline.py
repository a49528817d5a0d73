import numpy as np
import pytest

from ledgerflow.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas().set_index("doc_id")
        assert set(after.index) <= set(before.index)
        if name == "suffix_array_dedup":
            assert set(after.index) == set(before.index) and (after.n_chars == after.text.str.len()).all()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed.doc_id) == set(before.index) and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    whole = corpus_pipeline.run(spark, DATA).toPandas()
    assert np.array_equal(np.sort(whole.ids_crc32), np.sort(packed.ids_crc32))


@pytest.mark.parametrize("name", list(queries.QUERIES), ids=lambda f: f.__name__)
def test_every_query_runs(spark, name):
    assert name(spark, DATA).count() > 0


def test_edges(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids; and no rows at all."""
    from .helpers import EDGES

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 4 else None, None if t is None else len(t)) for n, (i, t) in enumerate(EDGES)]
    rows += [(100 + i, " ".join(f"w{i * 31 % 97}x{k * i % 89}" for k in range(60)), "en", "s", 1) for i in range(1, 30)]
    for name, documents, labels in (("edges", rows, [(100 + i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 20)] + [(None, 1, 1), (101, None, None)]), ("nolabels", rows, []), ("empty", [], [])):
        d = tmp_path / name
        spark.createDataFrame(documents, schema).coalesce(1).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(d / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(d)).toPandas()
        assert set(packed.doc_id.dropna()) <= {r[0] for r in documents}
        assert not len(packed) or (packed.groupby("sequence_id").length.sum() <= 2048).all()
