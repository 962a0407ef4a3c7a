"""Training-data operators: mixing, archives, quality, tokens, language models, near-duplicates,
search, licences.  Nothing outside this package imports it; the registry entry point adds its
queries only when the package is present."""
