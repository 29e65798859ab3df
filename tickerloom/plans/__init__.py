"""Named queries and their SQL counterparts."""


def load():
    """Import every query module; returns (queries, oracle SQL)."""
    from tickerloom.plans import (  # noqa: F401
        graph_queries,
        market_queries,
        model_queries,
        news_queries,
        registry,
        stream_queries,
        text_queries,
    )

    return dict(registry.QUERIES), dict(registry.ORACLES)
