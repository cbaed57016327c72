"""Training-data operators: decontamination, language ID, licence and secret scans, chat formatting,
near-duplicates, nearest neighbours, HTML extraction, packing and toxicity."""
