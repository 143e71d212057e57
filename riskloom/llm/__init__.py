"""Training-data operators: packing, language ID, decontamination, joins, dedup, scans, extraction."""
