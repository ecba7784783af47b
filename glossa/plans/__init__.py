"""The registered reference queries and their SQL counterparts."""
