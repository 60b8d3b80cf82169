"""girasol: analytics on labelled vectors and the text they come from, as Spark plans."""
