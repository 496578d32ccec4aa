"""Training-data pipeline operators (toxicity, decontamination, secrets, PII,
revisits, token output, quality, near-duplicates, quality rules, mixing,
periodic runs, phrase collocations, packing).

Nothing else in the library imports this subpackage.  ``registry`` names its
queries; every operator module states its contract in its docstring.
"""
