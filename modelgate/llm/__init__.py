"""Training-data operators: ten corpus operators and the stages built on them.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
