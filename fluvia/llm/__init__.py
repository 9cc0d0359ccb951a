"""Training-data operators: tokenising, joins, extraction, classifiers, sharding.

Nothing outside this package imports it.
"""
