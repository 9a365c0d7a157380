"""Operations of a training-data pipeline: mixing, near-duplicate joins, scoring, filters, search.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`tidemark.llm.registry` derives the
registered queries from them.
"""
