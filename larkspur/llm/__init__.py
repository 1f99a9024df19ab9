"""Training-data operators: dedup, quality, mixing, toxicity, HTML, media, sharding and BPE.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
