"""Reading and writing tables, texts and journals."""
