"""Readers and writers: folder listings, caption files, run metadata, event lines, dataset export."""
