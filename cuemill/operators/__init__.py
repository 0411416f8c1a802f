"""DataFrame operators: corpora, timelines, rendering, conversations."""
