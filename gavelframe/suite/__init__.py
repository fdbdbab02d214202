"""All registered queries; importing the modules fills the registry."""

from gavelframe.suite import agents, analysis, estimates, filters, linking, statistics, tables, texts  # noqa: F401
from gavelframe.suite.registry import HEADLINE, QUERIES, SQL  # noqa: F401
