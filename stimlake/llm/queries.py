"""Queries of the problems that this subpackage solves, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stimlake.llm.clusters import describe, located_clusters
from stimlake.llm.knn import most_similar
from stimlake.llm.leaks import find_leaks
from stimlake.llm.nearest_time import match_nearest
from stimlake.llm.packing import count_tokens, mixtures, pack_texts
from stimlake.llm.personal import find_personal, linked_values, personal_details, redact_personal
from stimlake.tables import cut, table

RF_DIM = 96


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the clusters of neurons by receptive field and position."""
    where = table(spark, sf_dir, "neurons").filter("neuron IS NOT NULL AND py IS NOT NULL AND px IS NOT NULL").select(F.col("neuron").alias("id"), F.col("py").alias("y"), F.col("px").alias("x"))
    fields = table(spark, sf_dir, "rf").select(F.col("neuron").alias("id"), F.col("rfs").alias("vec"))
    return located_clusters(where, fields, dim=RF_DIM)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_members(spark, sf_dir).select(F.col("id").alias("neuron"), F.col("cluster").alias("cluster_key"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster by its size and its most typical neurons."""
    return describe(p2_members(spark, sf_dir))


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest tick and nearest encoder sample of every flip, with the time between them."""
    side = lambda df, key: df.select(F.col("expt").cast("long").alias("entity"), F.col(key).alias("id"), "t")
    flips, ticks = table(spark, sf_dir, "sync_flips"), table(spark, sf_dir, "frame_times")
    daq = table(spark, sf_dir, "timeline").filter(F.lower(F.trim("channel")) == "rotary_encoder")
    tolerance = table(spark, sf_dir, "recordings").select(F.col("expt").alias("entity"), F.col("tol_s").alias("tol"))
    got = match_nearest(side(flips, "flip_id"), {"tick": side(ticks, "tick_id"), "daq": side(daq, "row_id")}, tolerance)
    return got.select(F.col("id").alias("flip_id"), F.col("kind").alias("ref_kind"), "ref_id", F.round("dt", 6).alias("dt"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_matches(spark, sf_dir).drop("dt")


def _p3_sql(kind: str, rows: str) -> str:
    return f"""SELECT flip_id, '{kind}' AS ref_kind, ref_id, round(dt, 6) AS dt FROM (
      SELECT f.flip_id, r.ref_id, r.t - f.t AS dt, row_number() OVER (PARTITION BY f.flip_id ORDER BY abs(r.t - f.t), r.t, r.ref_id) AS k
      FROM f JOIN ({rows}) r ON r.expt = f.expt AND r.t BETWEEN f.t - f.tol_s AND f.t + f.tol_s AND abs(r.t - f.t) < f.tol_s) WHERE k = 1"""


P3_SQL = f"""
WITH f AS (SELECT DISTINCT flip_id, CAST(s.expt AS BIGINT) AS expt, t, tol_s FROM sync_flips s JOIN recordings c ON c.expt = s.expt WHERE t IS NOT NULL AND NOT isnan(t))
{_p3_sql("tick", "SELECT DISTINCT tick_id AS ref_id, expt, t FROM frame_times WHERE t IS NOT NULL AND NOT isnan(t)")}
UNION ALL
{_p3_sql("daq", "SELECT DISTINCT row_id AS ref_id, expt, t FROM timeline WHERE lower(trim(channel)) = 'rotary_encoder' AND t IS NOT NULL AND NOT isnan(t)")}
"""


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rf").select(F.col("neuron").alias("id"), F.col("rfs").alias("vec"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar neurons of every neuron whose number is divisible by 20, against all.

    Most of them are like no other (their nearest has a cosine of 0.5), which is where an index misses most: more parts
    are visited and more candidates reranked."""
    vectors = _fields(spark, sf_dir)
    return most_similar(vectors, vectors.filter("id % 20 = 0").select("id"), dim=RF_DIM, k=5, visits=192, candidates=1024)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = most_similar(_fields(spark, sf_dir), table(spark, sf_dir, "probes").select(F.col("neuron").alias("id")), dim=RF_DIM, k=5)
    return got.select(F.least("id", "other").alias("neuron_a"), F.greatest("id", "other").alias("neuron_b")).distinct()


CAPACITY = 8192


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of one longer than a container, with its container of 8192 tokens."""
    sizes = cut(count_tokens(table(spark, sf_dir, "documents")), "sizes")
    return pack_texts(sizes, capacity=CAPACITY)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of each container, how far its mixture of sources is off the target, and how far all containers so far are."""
    return mixtures(cut(p6_packed(spark, sf_dir), "containers"), CAPACITY)


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items they contain: the longest passage of each, and how many of the words around a rare one (11 on
    each side) stand within two places of where they should."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), slop=2, near_terms=18)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


#: Escape sequences are undone as spaces here: those of letters would need a function that SQL lacks.
_WORDS = "regexp_extract_all(lower(regexp_replace({0}, '\\\\+(u[0-9a-fA-F]{{4}}|x[0-9a-fA-F]{{2}}|[nrtvfab0])', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+')"
P7_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM eval_items WHERE item_id IS NOT NULL), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i)),
own AS (SELECT phrase, min(item_id) AS item_id FROM p GROUP BY phrase HAVING count(*) = 1),
x AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM x JOIN own USING (phrase)
"""


#: An example; a user passes a secret one.
KEY = b"example key"


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the placeholders of each document stand for, as it was written."""
    return find_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_list"), KEY)


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with placeholders."""
    return redact_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_list"), KEY).drop("details")


def p8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that several documents share, by their pseudonyms."""
    return linked_values(cut(personal_details(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_list"), KEY), "details"))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters, "p3_found": p3_found, "p3_matches": p3_matches, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_packed": p6_packed, "p6_containers": p6_containers, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_redacted": p8_redacted, "p8_links": p8_links}
SQL = {"p3_found": f"SELECT flip_id, ref_kind, ref_id FROM ({P3_SQL})", "p3_matches": P3_SQL, "p7_found": P7_SQL}
