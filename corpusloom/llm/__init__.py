"""Training-data operators: packing, language, duplicates, quality, contamination, pages and chats.

Nothing outside this package imports it.
"""
