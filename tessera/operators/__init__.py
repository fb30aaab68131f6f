"""DataFrame -> DataFrame operators: predicates, joins, ranking, retrieval, citations, ingestion."""
