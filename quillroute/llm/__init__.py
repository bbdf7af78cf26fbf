"""Training-data operators: language ID, packing, HTML extraction, quality rules, BPE,
exact top-k search, toxicity, license scans, near-duplicates, line de-duplication, spelling
variants, hard negatives and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
