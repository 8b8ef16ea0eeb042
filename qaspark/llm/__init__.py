"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this package imports it. ``queries.py`` registers one query
per operator (``opN_<name>``) and the pipeline of ``corpus_pipeline.py``.
"""
