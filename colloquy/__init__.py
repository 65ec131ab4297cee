"""Transcript analytics on Spark: cleaning, alignment, glossary, fact checking, minutes."""
