"""Operators for preparing training corpora: one module each, plus their queries in ``queries``."""
