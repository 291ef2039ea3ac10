"""Operations of a training-data pipeline, each a Spark job over ``documents``-like tables.

Nothing outside this subpackage imports it.  ``queries.py`` registers the thin
``opN_<name>`` queries; each operator keeps its own general interface in its own module.
"""
