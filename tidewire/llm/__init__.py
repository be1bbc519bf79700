"""Operators for training data: tokens, archives, classifiers, joins, sharding, decontamination."""
