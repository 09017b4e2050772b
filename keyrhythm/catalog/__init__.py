"""Every operator run on the given tables, each with its SQL check where SQL can express it."""

from keyrhythm.catalog import cleaning, evaluation, exploration, models, profiles, raw, sequences, sessions, streams  # noqa: F401
from keyrhythm.catalog.registry import QUERIES, SQL  # noqa: F401
