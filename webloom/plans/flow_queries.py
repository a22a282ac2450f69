"""Queries over whole flows."""

from pyspark.sql import functions as F

from webloom.model import SelectorRule
from webloom.operators import quality
from webloom.plans import derived, flows
from webloom.plans.registry import query, sql_normalize_url, sql_squeeze, table

_TITLE = "nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')"


@query("score_page_corpus", f"""WITH r AS (SELECT {sql_squeeze(_TITLE)} AS title, {sql_normalize_url('url')} AS url FROM pages),
  t AS (SELECT count(*) AS n, sum((coalesce(title, '') <> '')::INT + (coalesce(url, '') <> '')::INT) AS filled, count(DISTINCT (title, url)) AS u FROM r)
  SELECT round((0.4 * filled / (2 * n) + 0.35 + 0.25 * u / n) * 100, 1) AS overall_score, n AS total_records, n - u AS duplicates FROM t""")
def score_corpus(spark, d):
    return flows.score_page_corpus(spark, d).select("overall_score", "total_records", F.col("duplicate_records_count").alias("duplicates"))


@query("extract_clean_score", """WITH r AS (SELECT p_name AS name, p_retailprice AS price, p_partkey FROM part WHERE p_partkey % 50 <> 0)
  SELECT count(*) AS total_records, round((0.4 + 0.35 + 0.25 * count(DISTINCT (name, price, p_partkey)) / count(*)) * 100, 1) AS overall_score FROM r""")
def extract_clean_score(spark, d):
    rules = [SelectorRule("name", "h1"), SelectorRule("price", ".price"), SelectorRule("canonical_url", "link[rel='canonical']", extract_type="attr")]
    cleaners = [{"field_name": "price", "action": "to_float"}, {"field_name": "name", "action": "trim"}, {"field_name": "canonical_url", "action": "normalize_url"}]
    records = flows.page_records(derived.product_pages(spark, d), rules, cleaners)
    return quality.quality_report(records, fields=["name", "price", "canonical_url"]).select("total_records", "overall_score")


@query("page_chunks")
def page_chunks(spark, d):
    return flows.corpus_to_chunks(table(spark, d, "pages"))
