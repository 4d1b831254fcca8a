"""Operations of a training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it; ``queries`` registers what it offers.
"""
