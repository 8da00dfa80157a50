"""Rules, and what a rule becomes once it is bound to a schema."""
