"""Training-data operators: deduplication, packing, mixing, token counts, search, toxicity and chat formatting."""
