"""Vocabulary review over document collections, expressed in Spark DataFrames.

`suggest` and `apply_choices` take one text or a DataFrame of documents; importing this
package starts no session and reads no lexicon.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from .sources.lexicon import Lexicon

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

__all__ = ["Lexicon", "Match", "apply_choices", "suggest"]


@dataclass
class Match:
    """One occurrence: its offsets, the words as found, and what is offered instead."""

    span: tuple[int, int]
    surface: str
    base: str
    suffix: str
    alternatives: list[str] = field(default_factory=list)


def suggest(text: str | DataFrame, lexicon: Lexicon | None = None, context: bool = False) -> Any:
    """A list of Match for a text; for a DataFrame (doc_id, text), batch or streaming, one row an occurrence."""
    from .operators.suggest import suggest as over

    if not isinstance(text, str):
        return over(text, lexicon, context)
    from .session import get_session
    from .sources.texts import from_texts

    rows = over(from_texts(get_session(), [text]), lexicon).orderBy("match_ord").collect()
    return [Match((r["start"], r["end"]), r["surface"], r["base"], r["suffix"], list(r["alternatives"])) for r in rows]


def apply_choices(text: str | DataFrame, choices: Any) -> Any:
    """The text with ((start, end), replacement) pairs put in; for DataFrames, (doc_id, revised).

    Choices that are not in document order or overlap are a ValueError; over a DataFrame, an
    error of the job that reads the result.
    """
    from .operators.apply import apply_choices as over
    from .operators.apply import choice_errors

    if not isinstance(text, str):
        return over(text, choices)
    if not choices:
        return text
    from .session import get_session
    from .sources.texts import from_texts

    spark = get_session()
    rows = [(0, i, a, b, t) for i, ((a, b), t) in enumerate(choices)]
    table = spark.createDataFrame(rows, "doc_id bigint, choice_ord int, start bigint, end bigint, replacement string")
    wrong = choice_errors(table).first()
    if wrong is not None:
        raise ValueError(wrong["error"])
    return over(from_texts(spark, [text]), table, validate=False).first()["revised"]
