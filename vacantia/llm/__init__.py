"""Training-data operators: deduplication, filtering, extraction, encoding.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
