"""Statistics of annotated text corpora at glyph, word, line and page level, as DataFrame plans."""
