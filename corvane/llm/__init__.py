"""Training-data operators: language ID, scans, search, joins, dedup, packing, tokenizing.

Nothing outside this folder imports it.  Every operator takes DataFrames and
column names, so that its queries (``llm.queries``) and the corpus pipeline are
thin callers.
"""
