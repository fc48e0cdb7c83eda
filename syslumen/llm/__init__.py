"""Training-data operators: one module each, with their queries in ``queries.py``.

Nothing outside this package (but ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
