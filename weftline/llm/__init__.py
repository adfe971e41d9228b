"""Training-data operators: ten corpus-scale steps, each usable on its own.

Nothing outside this package imports it; `queries.py` registers its queries.
"""
