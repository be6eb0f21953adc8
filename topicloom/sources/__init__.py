"""Reading and writing corpora, vocabularies and histories."""
