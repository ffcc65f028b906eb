from pyspark.sql import functions as F

from balsam.functions import text as T
from balsam.streaming import masked_stream, run_to_table
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").schema
    s = masked_stream(spark, SF_SMALL, schema, ["text"], glob="documents.parquet",
                      mask_entities=True, mask_locations=True)
    got = {r["doc_id"]: r["text"] for r in run_to_table(s.select("doc_id", "text"), "t").collect()}
    batch = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        "doc_id", T.mask_terms_longest(T.mask_patterns_ordered(T.fill_text(F.col("text"))), T.PROVINCE_NAMES).alias("text"))
    want = {r["doc_id"]: r["text"] for r in batch.collect()}
    assert got == want and len(got) > 0


def test_stream_of_part_files(spark, tmp_path):
    """A table may be one file or a folder of part files; a stream without rows keeps its schema."""
    from balsam.plans.text_plans import q_stream_mask
    spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(4) \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    (part,) = [p for p in (tmp_path / "documents.parquet").iterdir() if p.name.startswith("part-00000")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "documents.parquet").write_bytes(part.read_bytes())
    want = {i: f"text {i}" for i in range(40)}
    assert {r["doc_id"]: r["text"] for r in q_stream_mask(spark, str(tmp_path)).collect()} == want
    got = {r["doc_id"]: r["text"] for r in q_stream_mask(spark, f"{tmp_path}/one").collect()}
    assert got and got.items() <= want.items()
    none = masked_stream(spark, str(tmp_path), "doc_id long, text string", ["text"], glob="absent.parquet")
    assert run_to_table(none, "none").columns == ["doc_id", "text"]
