"""SQL names for the functions: `register(spark)` makes them usable from `spark.sql`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusengine.functions.arrow import cut_recursively, minhash, nfkc_udf, recursive_chunks
from corpusengine.functions.text import WS
from corpusengine.operators.chunking import PLAIN_SEPARATORS


class SplitChunks:
    """`split_chunks(text, size, overlap)`: one row per chunk, for lateral joins."""

    def eval(self, text: str, size: int, overlap: int):
        if text and text.strip():
            pieces = cut_recursively(text, size, overlap, PLAIN_SEPARATORS)
            yield from enumerate(pieces, 1)


SQL_FUNCTIONS = {
    "dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "l2sq": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    "word_set": f"(a STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter(split(lower(a), r'{WS}+'), w -> w <> ''))",
    "word_overlap": "(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN size(array_union(word_set(a), word_set(b))) > 0 "
    "THEN size(array_intersect(word_set(a), word_set(b))) / size(array_union(word_set(a), word_set(b))) ELSE 0D END",
    "confidence": f"""(body STRING, keywords ARRAY<STRING>) RETURNS DOUBLE RETURN
        CASE WHEN body IS NULL OR body = '' THEN 0D ELSE round(
          0.5D * CASE WHEN length(body) BETWEEN 80 AND 200 THEN 1D ELSE 0.6D END
          + 0.3D * CASE WHEN keywords IS NULL OR size(keywords) = 0 THEN 0.5D
                   ELSE size(filter(keywords, k -> k <> '' AND contains(lower(body), lower(k)))) / size(keywords) END
          + 0.2D * CASE WHEN body RLIKE r'[.!?]{WS}*$' THEN 1D ELSE 0.7D END, 3) END""",
}


def register(spark: SparkSession) -> None:
    spark.udf.register("nfkc", nfkc_udf)
    spark.udf.register("minhash", minhash())
    spark.udf.register("recursive_chunks", recursive_chunks(800, 150, PLAIN_SEPARATORS))
    split_chunks = udtf(SplitChunks, returnType="index_in_para INT, chunk_text STRING", useArrow=True)
    spark.udtf.register("split_chunks", split_chunks)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
