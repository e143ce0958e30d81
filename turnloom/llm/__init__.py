"""Training-data operators: mixing, deduplication, filtering, tokenization and search.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
