"""All registered queries, by operator family."""

from tallystar.queries import events, files, layouts, messages, search, sql_surface, star
from tallystar.queries.tables import Query

_FAMILIES = [star, layouts, files, search, messages, events, sql_surface]

REGISTRY: dict[str, Query] = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
