"""Training-data operators: quality, tokenisation, secrets, near-duplicates, toxicity, language-model scores."""
