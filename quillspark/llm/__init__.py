"""Training-data operators: tokens, toxicity, decontamination, packing, quality,
language, substring and n-gram de-duplication, URL filters and WARC salvage."""
