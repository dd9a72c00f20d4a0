"""Query catalogue, one module per group of operators."""

from importlib import import_module

GROUPS = [
    "text", "rules", "gazetteer", "routing", "evaluation", "drift", "features", "models", "timelog", "images",
    "sources", "streaming",
]


def load() -> None:
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
