"""Training-data pipeline operators: fingerprints, token counts, HTML extraction, quality
rules, language identification, packing, near-duplicates, secrets, licences, BPE.

Nothing outside this folder imports it; its queries are in ``quire.llm.queries``.
"""
