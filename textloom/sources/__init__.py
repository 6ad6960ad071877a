"""Sources and sinks: source trees, JSON-lines corpora, model servers."""
