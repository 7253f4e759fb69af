"""Where patches, rules and source trees come from."""
