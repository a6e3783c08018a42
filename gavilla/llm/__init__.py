"""Operators for training-data pipelines: quality, decontamination, extraction, tokens, chat, near copies, urls, licences, toxicity, archives."""
