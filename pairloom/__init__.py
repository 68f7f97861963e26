"""Matching of documents with requirement texts on Spark: curation, extraction, candidates, scoring, evaluation."""
