"""Operators for preparing language-model training corpora.

Each module holds one operator with a DataFrame-in, DataFrame-out interface;
``queries.py`` registers the thin ``opN_<name>`` queries built on them.
"""
