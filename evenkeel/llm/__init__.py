"""Operators for training data: quality, tokens, archives, near copies, mixing, search.

Nothing else in the library imports this subpackage. Every operator takes the columns it names
and ignores all others, so extra columns never clash; null texts count as empty; repeated rows
are kept as rows of their own; an empty table gives an empty result of the same columns.
"""
