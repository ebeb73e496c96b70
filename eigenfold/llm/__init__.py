"""Operators for preparing training text: extraction, language, search, tokens,
toxicity, near-duplicates, licences, chat formatting and packing.

Every operator takes DataFrames and returns DataFrames; ``queries`` holds the
queries registered in ``__spark_entry__``.
"""
