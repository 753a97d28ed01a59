"""Source tables to the document table with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.fixed_values import NAMESPACES
from innsight.operators import documents as dc
from innsight.operators import sentences as st
from innsight.sources import tables


def build_corpus(
    booking: DataFrame | None, airbnb: DataFrame | None, city: str | None = None, limit: int | None = None
) -> DataFrame:
    """Documents of both sources in their four namespaces; either source may be absent."""
    parts = []
    if booking is not None:
        parts += [dc.booking_hotel_documents(booking, city, limit), dc.booking_review_documents(booking, city, limit)]
    if airbnb is not None:
        parts += [dc.airbnb_hotel_documents(airbnb, city, limit), dc.airbnb_review_documents(airbnb, city, limit)]
    return dc.corpus(*parts)


def with_vectors(documents: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Append the embedding of each document's text."""
    return st.embed(documents, model, text_col)


def ingest(
    spark: SparkSession, path: str, booking: DataFrame | None, airbnb: DataFrame | None, *, version: int,
    model=None, clear_existing: bool = True, city: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Write the corpus to the document table and return its summary per namespace.

    ``clear_existing`` replaces the four namespaces. What they held goes when the new files
    stand; a namespace that receives nothing is removed afterwards. It can be repeated.
    """
    documents = build_corpus(booking, airbnb, city, limit)
    if model is not None:
        documents = with_vectors(documents, model)
    written = tables.upsert_documents(spark, path, documents, version, replace=NAMESPACES if clear_existing else ())
    if clear_existing:
        tables.drop_namespaces(spark, path, [n for n in NAMESPACES if n not in written])
    return dc.namespace_summary(tables.read_documents(spark, path).filter(F.col("namespace").isin(NAMESPACES)))
