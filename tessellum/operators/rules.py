"""Ordered dictionaries of phrases: of those that a text contains, the first rule counts.

All phrases are found in one pass of a text by an automaton, whatever their number, instead of one search a phrase. The
rules go to the workers once, in a broadcast; a worker builds its automaton from them. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, each list in the order of its rules: phrase, then what it says.
#: Section, years of life (two where it depends) and asset class of components.
COMPONENTS = (
    ("carpet", "1245", "5", "57.0"),
    ("kitchen appliance", "1245", "5", ""),
    ("hvac", "1245 or 1250", "", ""),
    ("electrical wiring", "1250", "39", ""),
    ("light fixture", "1245", "5 or 7", ""),
    ("parking lot", "1250", "15", ""),
    ("sidewalk", "1250", "15", ""),
)
#: Category of objects.
CATEGORIES = (
    ("light fixture", "fixture"), ("plumbing fixture", "fixture"), ("appliance", "equipment"), ("hvac unit", "equipment"), ("flooring", "improvement"), ("wall covering", "improvement"),
    ("wall", "structural"), ("foundation", "structural"), ("roof", "structural"), ("artwork", "decorative"), ("decorative molding", "decorative"),
)
#: How objects are attached.
ATTACHMENTS = (("permanent", "permanent"), ("removable", "removable"), ("built-in", "built_in"), ("built in", "built_in"), ("freestanding", "freestanding"))
#: Space category of rooms.
SPACES = (
    ("lobby", "common_area"), ("hallway", "common_area"), ("elevator", "common_area"), ("shared", "common_area"), ("apartment", "unit_space"), ("office", "unit_space"), ("unit", "unit_space"),
    ("mechanical room", "service_area"), ("storage", "service_area"), ("utility", "service_area"), ("outdoor", "exterior"), ("parking", "exterior"), ("landscaping", "exterior"),
)
#: Class of a property and its recovery in years.
PROPERTIES = (
    ("apartment", "residential_rental", "27.5"), ("condo", "residential_rental", "27.5"), ("house", "residential_rental", "27.5"), ("office", "commercial", "39"), ("retail", "commercial", "39"),
    ("warehouse", "commercial", "39"), ("manufacturing", "industrial", "39"), ("distribution", "industrial", "39"),
)
# End of the fixed values.


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, phrase in reversed(list(enumerate(phrases))):  # of equal phrases the first stays
        if phrase:
            found.add_word(phrase, k)
    found.make_automaton()
    return found


def first_rule(rows: DataFrame, text_col: str, phrases: Sequence[str], name: str = "rule") -> DataFrame:
    """rows with the number, from 0, of the first of the phrases that the text contains in any case; null if it has none or is null.

    An empty phrase is in no text. Of equal phrases the first counts. Letters are lower-cased as Spark's lower() does.
    """
    held = rows.sparkSession.sparkContext.broadcast(tuple(p.lower() for p in phrases))
    schema = rows.withColumn(name, F.lit(None).cast("int")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _automaton(held.value) if any(held.value) else None
        for batch in batches:
            numbers = []
            for text in batch["_lowered"].to_pylist():
                least = None
                for _, k in known.iter(text) if known is not None and text else ():
                    if least is None or k < least:
                        least = k
                        if not k:
                            break
                numbers.append(least)
            columns = [batch[f] for f in batch.schema.names if f != "_lowered"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32())], [*[f for f in batch.schema.names if f != "_lowered"], name])

    return rows.withColumn("_lowered", F.lower(F.col(text_col).cast("string"))).mapInArrow(run, schema)


def labelled(rows: DataFrame, text_col: str, rules: Sequence[tuple[str, ...]], *names: str) -> DataFrame:
    """rows with a column for each thing that the first rule found says, null without one."""
    found = first_rule(rows, text_col, [r[0] for r in rules], "_rule")
    said = [F.get(F.array(*[F.lit(r[k]) for r in rules]), F.col("_rule")).alias(name) for k, name in enumerate(names, 1)]
    return found.select(*rows.columns, *said)
