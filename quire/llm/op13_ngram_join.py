"""Similarity join of documents by their n-grams: a blocked sparse product of the document by n-gram incidence matrix.

A row of the matrix is the set of distinct word n-grams of a text (all words of a shorter one). Two documents are linked if the
Jaccard similarity of their rows is at least ``similarity``; what is wanted is the groups that links connect.

Equal texts are one row. Which rows have to meet in a block follows from their sizes: of two rows that are similar enough, the
first n - ceil(s n) + 1 n-grams, rare ones first, must have one in common, so rows gather around the smallest row they share
such an n-gram with, and parts of a cluster whose beginnings can't reach the bound leave it. Clusters are dealt into blocks of a
bounded size, and clusters of several blocks are gone through block pair by block pair. Inside a block
(``quire.llm.overlap``) the product of a strip of rows with all rows is accumulated by blocks of columns, and pairs below the bound that
their sizes give are discarded between them. A block gives at most one link less than it has rows, so no group of copies is ever a
list of pairs; rows of one group aren't compared again. The rounds are those of ``near_duplicates``, which describes them.

Rows are sets of 64-bit hashes of n-grams, and texts are told apart by 64-bit hashes.

Nulls: a null text counts as empty; texts without words are in no group but their own. A null doc_id is a group's id only
if the group has no other. Very long texts are compared whole, one larger than a block in a block of its own. Repeated rows and ties all keep their
rows. An empty table gives no rows. The result has this operator's columns only, whatever others the table has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch, settle, small_batches, small_side, table
from quire.llm.near_duplicates import BLOCK_BYTES, near_duplicate_classes


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    with scratch(docs.sparkSession) as outer:
        rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(body).alias("node"), body.alias("body"))
        classes = near_duplicate_classes(rows, shingle, similarity, None, block_bytes, empty=False)
        least = settle(classes.groupBy("label").agg(F.min("least").alias("component")))
        found = small_side(classes.join(least, "label").select("node", "component", F.col("size").cast("long").alias("n_shingles")))
        component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc"))
        return settle(rows.select("doc", "node").join(found, "node").select(F.col("doc").alias("doc_id"), "n_shingles", component.alias("component_id")), outer)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


QUERIES = {"op13_ngram_join": op13_ngram_join}
#: All pairs that share a shingle, and what links reach from each document.
SQL = {
    "op13_ngram_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT r, unnest(g) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM e a JOIN e b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
reach AS (SELECT r, r AS q FROM s UNION SELECT reach.r, b FROM reach JOIN links ON q = a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least AS component_id FROM s JOIN (SELECT reach.r, min(doc_id) AS least FROM reach JOIN s ON s.r = q GROUP BY reach.r) USING (r)""",
}
