"""Operators that prepare text corpora for training language models, one module each.

Two conventions hold throughout. A *document* is a distinct pair of id and text: rows repeated in
full are one document and each gets its answer. A null text counts as an empty one, and a null id
is an id like any other. Operators read only the columns they name, so further columns of any name
pass through or are left out, never confused with their own.
"""
