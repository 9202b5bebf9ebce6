"""All rules; importing this package registers them in module order."""

from vellum.plans.rules import audit, code, hub, links, menu, questions, reports, stale  # noqa: F401
