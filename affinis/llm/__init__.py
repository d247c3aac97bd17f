"""Training-data operators: packing, media, chat, dedup, PII, ANN, URL filters, SentencePiece, toxicity.

Nothing outside this subpackage imports it; its queries and SQL are in ``affinis.llm.queries``.
"""
