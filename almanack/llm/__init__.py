"""Training-data operators: archives, near-duplicates, decontamination, tokens, chat, search, models.

Nothing outside this subpackage imports it.
"""
