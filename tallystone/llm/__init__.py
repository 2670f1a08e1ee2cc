"""Training-data operators: sharding, classifiers, licences, tokens, dedup, mixing, rules, media."""
