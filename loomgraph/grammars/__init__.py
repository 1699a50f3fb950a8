"""Domain grammars: rules as data over the text of articles, and the records and triples that they give."""
