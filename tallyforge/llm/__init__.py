"""Operators for preparing training corpora: quality, duplicates, decontamination, languages, mixing, archives."""
