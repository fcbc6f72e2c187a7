"""Training-data operators: sharding, mixing, dedup, filters, search, language ID, audits.

Nothing outside this folder imports it; ``__spark_entry__`` registers its queries when it is present.
"""
