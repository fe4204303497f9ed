"""Training-data operators: ten corpus operators over document tables.

Nothing outside this package imports it; the queries live in ``queries``.
"""
