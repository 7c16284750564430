"""Readers and writers for corpora, run histories, images and result tables."""
