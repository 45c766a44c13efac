"""Training-data operators: archives, deduplication, filtering, tokens.

Nothing outside this subpackage imports it; removing it leaves the rest of the library whole.
"""
