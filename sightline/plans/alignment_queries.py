"""Alignment of buckets made of the parts: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import align as al
from sightline.operators import unify as un
from sightline.plans import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def buckets(spark, sf):
    """A bucket for each name and brand of a part: its concept, the words of both as keywords, the part types as
    entities, two of them as examples."""
    types = F.array_sort(F.collect_set("p_type")).alias("entities")
    rows = fx.table(spark, sf, "part").groupBy("p_name", "p_brand").agg(types)
    concept = F.concat_ws(" ", "p_name", "p_brand")
    return rows.select(
        concept.alias("bucket_id"), concept.alias("concept"), F.lit("").alias("definition"), F.slice("entities", 1, 2).alias("examples"),
        F.array_distinct(F.split(concept, " ")).alias("keywords"), "entities",
    )


KEYED = """keyed AS (SELECT DISTINCT concept AS bucket_id, unnest(string_split(concept, ' ')) AS keyword, length(concept) + 40 AS tokens FROM (SELECT DISTINCT p_name || ' ' || p_brand AS concept FROM part))"""


@query(f"""WITH RECURSIVE {KEYED}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY bucket_id) AS i FROM keyed),
w AS (SELECT keyword, bucket_id, tokens, i, CAST(0 AS BIGINT) AS chunk, tokens AS held FROM o WHERE i = 1
UNION ALL SELECT o.keyword, o.bucket_id, o.tokens, o.i, CASE WHEN 200 + w.held + o.tokens > 1000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN 200 + w.held + o.tokens > 1000 THEN o.tokens ELSE w.held + o.tokens END
FROM w JOIN o ON o.keyword = w.keyword AND o.i = w.i + 1) SELECT keyword, bucket_id, tokens, chunk FROM w""")
def token_chunks(spark, sf):
    rows = buckets(spark, sf).select(F.explode("keywords").alias("keyword"), "bucket_id", (F.length("concept") + 40).cast("long").alias("tokens"))
    return al.token_chunks(rows, "keyword", "bucket_id", "tokens", 1000, 200)


@query(f"""WITH {KEYED}, o AS (SELECT keyword, bucket_id AS entity, (row_number() OVER (PARTITION BY keyword ORDER BY bucket_id) - 1) // 20 AS w FROM keyed),
x AS (SELECT *, list_distinct(string_split(lower(entity), ' ')) AS words FROM o),
p AS (SELECT a.keyword, a.entity AS a, b.entity AS b, len(list_intersect(a.words, b.words)) AS n, len(a.words) + len(b.words) AS m FROM x a JOIN x b ON a.keyword = b.keyword AND a.w = b.w AND a.entity < b.entity)
SELECT keyword, a, b, round(n / (m - n), 6) AS score FROM p WHERE n / (m - n) >= 0.5""")
def pair_windows(spark, sf):
    rows = buckets(spark, sf).select(F.explode("keywords").alias("keyword"), F.col("bucket_id").alias("entity"))
    return al.proposed_pairs(rows, "keyword", 20)


#: Concepts of the parts' names, types and brands, as texts.
TEXTS = "texts AS (SELECT DISTINCT p_name || ' ' || p_type AS id FROM part)"


@query(f"""WITH {TEXTS}, g AS (SELECT id, substr(lower(id), i, n) AS term, count(*) AS tf FROM texts, range(1, 3) a(n), range(1, 200) b(i) WHERE i + n - 1 <= length(id) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM g GROUP BY term), w AS (SELECT id, term, tf * idf AS w FROM g JOIN idf USING (term)),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS similarity FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.85""")
def semantic_pairs(spark, sf):
    return al.similar_pairs(_texts(spark, sf), 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _texts(spark, sf):
    return fx.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("id")).distinct().withColumn("text", F.col("id"))


@query()
def semantic_groups(spark, sf):
    return al.semantic_groups(_texts(spark, sf))


@query()
def bucket_merge_rounds(spark, sf):
    merged, _ = al.merge_rounds(buckets(spark, sf), budget=2000, overhead=200)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return merged.select("bucket_id", "concept", joined("keywords"), joined("entities"), joined("examples"))


@query()
def bucket_merge_attach(spark, sf):
    return al.coarse_buckets(un.prefix_chunks(fx.names(spark, sf), 2, 5), 5)
