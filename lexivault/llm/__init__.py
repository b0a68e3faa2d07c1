"""Training-data operators: deduplication, decontamination, tokenising, language, licences, chat, neighbours.

Nothing else in the library imports this subpackage.
"""
