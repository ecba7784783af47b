"""Column expressions and driver-side word rules."""
