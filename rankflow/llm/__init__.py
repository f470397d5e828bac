"""Training-data operators: deduplication, filtering, mixing, sharding and token output.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it, so it can be
removed without touching the sequence engine.
"""
