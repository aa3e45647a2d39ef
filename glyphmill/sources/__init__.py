"""Readers and writers of page containers, banks, documents, replies and review sheets."""
