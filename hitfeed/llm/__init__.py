"""Training-data operators: near-duplicates, quality, language, tokens, mixing, PII, packing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
