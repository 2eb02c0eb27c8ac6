"""Training-data operators: toxicity, language, byte-pair codes, fingerprints, licence scans,
token counts, near-duplicate removal, chat formatting and packing.

Each module holds one operator with its own interface (DataFrame in, DataFrame out);
``queries.py`` registers one query for each of them over the whole test tables.
Nothing outside this package imports it.
"""
