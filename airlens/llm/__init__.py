"""Operations of a training-data pipeline: thirteen operators on documents, pages and conversations, each usable alone.

Nothing outside this package imports it; `queries` holds the registered queries.
"""
