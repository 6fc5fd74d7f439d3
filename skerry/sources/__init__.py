"""Readers. Each parser takes a DataFrame of text lines, so it runs on whatever produced them."""
