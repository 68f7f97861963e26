"""DataFrame operators: curation, extraction, candidates, scoring, blending, evaluation, labelling."""
