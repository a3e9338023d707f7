"""Training-data operators: secrets, duplicates, quality, toxicity, chat
formatting, rules, decontamination and source mixing.

Nothing else in the library imports this subpackage; it may import general
helpers of the library."""
