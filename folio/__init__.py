"""folio: a Spark-native engine for corpora of Markdown and HTML documents."""
