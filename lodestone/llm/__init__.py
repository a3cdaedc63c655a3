"""Training-data operators: packing, language id, dedup, decontamination, PII, WARC, toxicity, quality, licences."""
