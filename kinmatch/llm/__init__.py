"""Training-data operators: token counts, decontamination, BPE, PII, quality, near-duplicates, licences, language.

Each module holds one operator with a general interface (a DataFrame with an id and a text column in, a
DataFrame out). ``registry`` has the queries that apply them to the ``documents`` table.
"""
