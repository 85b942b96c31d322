"""Training-data operators: fingerprints, near duplicates, HTML extraction,
quality and toxicity scoring, packing, language id, language-model scoring and
subword sampling. Nothing outside this subpackage imports it."""
