"""Queries over the stored forms of the catalog; each equals the query that computes its answer anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lisible.operators import catalog as cat
from lisible.operators import catalog_store as store
from lisible.plans import documents as D
from lisible.plans import pages as P
from lisible.session import scratch_path

AUDIT_BATCHES = 3


def q_new_urls_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"url_index_{uuid.uuid4().hex[:12]}"
    store.open_url_index(spark, name, scratch_path(spark, "url-index"))
    store.add_urls(P.known_catalog(spark, sf_dir), name)
    return store.new_urls_indexed(P.submissions(spark, sf_dir), name, order_by="seq").select("seq", "page_id", "url")


def q_catalog_audit_merged(spark, sf_dir):
    """The exported catalog arrives in batches, each audited once; the audit merges the parts."""
    back, path = D._read_back(spark, sf_dir), scratch_path(spark, "audit-parts")
    for batch in range(AUDIT_BATCHES):
        store.write_audit_part(back.where(F.pmod("article_id", F.lit(AUDIT_BATCHES)) == batch), path, batch)
    return store.merged_audit(spark, path)


def q_listing_pages(spark, sf_dir):
    """The stored cards in order of their files and ids: nothing is sorted when they are read."""
    path = scratch_path(spark, "card-pages")
    store.write_cards(cat.article_cards(D.doc_catalog(spark, sf_dir)), path)
    cards = spark.read.parquet(f"{path}/cards")
    return cards.select(F.floor(F.col("article_id") / D.LISTING_PAGE_SIZE).cast("bigint").alias("page"), "article_id", "title", "level", "minutes", "band")


QUERIES = {
    "new_urls_indexed": q_new_urls_indexed,
    "catalog_audit_merged": q_catalog_audit_merged,
    "listing_pages": q_listing_pages,
}


def oracle() -> dict[str, str]:
    pages, docs = P.oracle(), D.oracle()
    return {"new_urls_indexed": pages["new_urls"], "catalog_audit_merged": docs["catalog_audit"], "listing_pages": docs["article_listing"]}
