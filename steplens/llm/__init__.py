"""Training-data operators: tokenising, packing, filtering, de-duplication, extraction and search."""
