"""Operations on text corpora: one module each, with its query on the given tables."""

from keyrhythm.llm import alignment, chat, decontaminate, hard_negatives, kneser_ney, line_dedup, mixing, near_dedup, outliers, personal_data, pseudo_likelihood, secrets, warc  # noqa: F401
from keyrhythm.llm.registry import QUERIES, SQL  # noqa: F401
