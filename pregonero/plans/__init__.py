"""Reports over the tender table: statistics, facets, analyses, quality and freshness."""
