"""Public-procurement analytics on Spark: ingest, normalise, extract, deduplicate, enrich and report tenders."""
