"""DataFrame operators: harvesting, ordering, near-duplicates, selection, QA data, evaluation, judging, statistics."""
