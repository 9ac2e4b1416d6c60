"""The registered queries: Spark implementations and their SQL counterparts."""
