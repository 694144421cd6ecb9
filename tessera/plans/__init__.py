"""From a declarative pipeline to one lazy plan."""
from tessera.plans.compile import Engine, Rows  # noqa: F401
