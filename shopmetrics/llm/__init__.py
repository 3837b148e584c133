"""Operators for preparing language-model training data.

One module per operator; ``queries`` binds them to the test tables. Nothing
outside this subpackage imports it. Text operators share three rules, stated
again where they matter: a null text counts as empty, texts are always read
whole, and only the columns an operator names are read from its input, so
extra columns (also ones named like its outputs) neither reach nor disturb it.
"""
