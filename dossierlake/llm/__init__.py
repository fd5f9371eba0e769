"""Training-data operators: formatting, deduplication, filtering, packing and counting of text."""
