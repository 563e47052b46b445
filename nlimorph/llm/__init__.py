"""Training-data operators: token counts, de-duplication, quality, language, packing.

Nothing outside this subpackage imports it; its queries live in ``queries.py``.
"""
