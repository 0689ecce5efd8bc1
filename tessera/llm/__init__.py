"""Training-data operators: packing, near duplicates, mixing, filtering and scanning.

Nothing outside this package imports it, and it imports nothing from the rest
of the library, so either can be removed without the other.
"""
