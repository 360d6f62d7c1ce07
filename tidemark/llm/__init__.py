"""Training-data operators: quality, deduplication, decontamination, tokens, secrets, pages and urls."""
