"""Training-data operators: sharding, quality, extraction, licences, URLs, dedup, decontamination, BPE, WARC."""
