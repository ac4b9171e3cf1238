"""Operators for preparing language-model training data at scale.

Every operator is a plain function over DataFrames.  Nothing outside this
subpackage imports it.
"""
