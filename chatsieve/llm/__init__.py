"""Operators for large training-data pipelines (one module per operator).

Nothing outside this subpackage imports it; the registered queries are in
``chatsieve.llm.plans`` and the chained job is ``corpus_pipeline.py``.
"""
