"""Training-data operators: near-dedup, exact substring dedup, scoring, language, decontamination, mixing, tokens, toxicity, chat."""
