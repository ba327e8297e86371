"""Operators of a training-data pipeline: nothing outside this subpackage imports them.

Every operator takes and returns DataFrames and has a general interface; the
thin ``opN_<name>`` queries over whole tables are in :mod:`notegrid.llm.queries`.
"""
