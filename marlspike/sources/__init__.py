"""Readers, tables and relations derived from them."""
