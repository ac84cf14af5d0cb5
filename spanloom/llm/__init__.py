"""Training-data operators: ten large-scale corpus operators and their queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when the
folder is there.
"""
