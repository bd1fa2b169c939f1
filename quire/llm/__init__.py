"""Operations of a training-data pipeline: deduplication, decontamination, filters, archives and tokenizers.

Nothing outside this subpackage imports it.
"""
