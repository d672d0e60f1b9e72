"""Training-data operators: quality, tokenising, language, duplicates, leaks, chat, HTML, sharding, media.

Nothing outside this subpackage imports it.
"""
