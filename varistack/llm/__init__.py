"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.
"""
