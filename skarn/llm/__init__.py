"""Training-data operators.

A self-contained subpackage: the rest of the library never imports it, and the
registry adds its queries only when it can be imported.
"""
