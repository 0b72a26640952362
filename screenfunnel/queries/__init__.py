from screenfunnel.queries import activity, library, ranking, routes, structures  # noqa: F401
from screenfunnel.queries.base import REGISTRY

__all__ = ["REGISTRY"]
