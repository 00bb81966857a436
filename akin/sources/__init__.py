"""Corpus readers, crawl lists and result tables."""
