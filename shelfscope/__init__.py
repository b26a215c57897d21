"""Analytics of digital-content marketplaces on Spark."""

from shelfscope.market import Market
from shelfscope.rules import Rules
from shelfscope.sources.files import Roles, read_roles, read_table, write_table
from shelfscope.sources.star import roles_from_star

__all__ = [
    "Market",
    "Roles",
    "Rules",
    "read_roles",
    "read_table",
    "roles_from_star",
    "write_table",
]
