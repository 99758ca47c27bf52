"""Which rows a search may see, and what counts as content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import strip

GLOBAL_TENANT = "global"

# Marks of front and back matter, sought in the first 500 characters in lower case.
NOT_CHAPTER = (
    "table of contents", "## preface", "\npreface\n", "## bibliography", "bibliography\n", "## subject index", "## index\n", "## acknowledgment", "## references\n",
    "list of figures", "list of tables", "errata\n", "## errata", "erratum", "typographical error", "all rights reserved", "copyright ©", "© 20", "© 19",
    "printed in the united states", "isbn ", "library of congress",
)
# Contents that stand for nothing, of a generated card and of a key fact.
EMPTY_CARD = ("n/a", "none", "not applicable", "no formula", "null", "")
EMPTY_FACT = ("n/a", "none", "not applicable", "null", "")


def in_scope(tenant: Column, mode: str | None, of: str) -> Column:
    """Study mode: None sees the tenant's rows and the global ones, base_textbook the global ones, anything else the tenant's.

    A null tenant is in no scope.
    """
    if mode is None:
        seen = tenant.isin(of, GLOBAL_TENANT)
    else:
        seen = tenant == (GLOBAL_TENANT if mode == "base_textbook" else of)
    return F.coalesce(seen, F.lit(False))


def is_chapter(text: Column) -> Column:
    """Whether a text's beginning carries no mark of front or back matter; null counts as chapter text."""
    head = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 500)
    return ~F.exists(F.array(*map(F.lit, NOT_CHAPTER)), lambda k: F.contains(head, k))


def says_something(content: Column, empty: tuple[str, ...] = EMPTY_CARD) -> Column:
    """Whether a content is neither null nor one of the stand-ins for nothing."""
    return F.coalesce(~F.lower(strip(content)).isin(*empty), F.lit(False))


def relevance_label(score: Column) -> Column:
    """The five steps of relevance shown beside a score."""
    steps = ((0.65, "Very relevant"), (0.55, "Highly relevant"), (0.45, "Relevant"), (0.35, "Somewhat relevant"))
    label = F.when(score >= steps[0][0], steps[0][1])
    for at, name in steps[1:]:
        label = label.when(score >= at, name)
    return label.otherwise("Loosely related")


def status_badge(status: Column) -> Column:
    """The badge of a processing state; an unknown state stands for itself."""
    badges = F.create_map(*(F.lit(x) for kv in {"ready": "Visual ready", "processing": "Visual processing", "failed": "Visual failed", "pending": "Visual pending"}.items() for x in kv))
    return F.coalesce(F.try_element_at(badges, status), status)


def embed_text(card_type: Column, title: Column, content: Column, answer: Column) -> Column:
    """What of a card is embedded: question and answer, or title and content."""
    return F.when(card_type == "question", F.concat_ws("\n", content, answer)).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit(": "), F.coalesce(content, F.lit(""))))
