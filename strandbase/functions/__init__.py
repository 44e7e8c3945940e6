"""Column functions: names and text (``names``), predicates (``filters``), manifest attributes (``attributes``)."""
