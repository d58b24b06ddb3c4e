"""Operations of a training-data pipeline: dedup, filters, formatting, mixing.

Nothing outside this subpackage imports it.
"""
