"""Training-data operators: search, quality, deduplication, language models, token output, packing and mixing."""
