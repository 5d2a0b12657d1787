"""Products: source rows, as declared frames, to checked and ordered data sets."""
