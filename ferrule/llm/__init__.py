"""Training-data operators: token counts, archives, URL rules, mixing, near-duplicates, media, quality, shards, repeats, BPE.

Nothing outside this package imports it.
"""
