"""Operators for training-data pipelines: fixity, deduplication, decontamination, cleaning, tokenizing.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
