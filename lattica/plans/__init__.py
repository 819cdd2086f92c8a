"""Query catalogues, one module per operator family."""

from importlib import import_module

FAMILIES = (
    "addressing",
    "topology",
    "stats",
    "series",
    "stencils",
    "channels",
    "pyramids",
    "sampling",
    "solver",
    "numerics",
)


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"lattica.plans.{name}")
