"""Incident classification by keywords and routing by ordered rules, both compiled to CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CLASSIFY_CONFIDENCE, KEYWORDS, ROUTING, SECTOR, TAXONOMY, URGENCY, check
from ..functions.text import strip


def incident_type(text: Column) -> Column:
    """The first type with a keyword in the text; blank texts are routine, others without a keyword other."""

    def kind(low: Column) -> Column:
        out = F.when(strip(low) == "", "routine")
        for label, words in KEYWORDS:
            out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), label)
        return out.otherwise("other")

    # the text in lower case is made once
    return F.get(F.transform(F.array(F.lower(text)), kind), F.lit(0))


def _mapped(values: dict[str, str], key: Column, default: str) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def urgency_of(kind: Column) -> Column:
    return _mapped(URGENCY, kind, "medium")


def sector_of(kind: Column) -> Column:
    return _mapped(SECTOR, kind, "general_support")


def recipients(kind: Column, urgency: Column, sector: Column) -> Column:
    """Of the first rule whose conditions all hold."""
    check()
    of = {"type": kind, "urgency": urgency, "sector": sector}
    out = None
    for when, to in ROUTING[:-1]:
        hit = reduce(lambda a, b: a & b, (of[k] == v for k, v in when.items()))
        out = (F if out is None else out).when(hit, F.array(*map(F.lit, to)))
    return out.otherwise(F.array(*map(F.lit, ROUTING[-1][1])))


def classified(states: DataFrame) -> DataFrame:
    """States with incident_type, urgency, sector, confidence and recipients. Failed readings are not classified: unknown, and for
    manual review."""
    failed = F.col("quality") == "failed"
    out = states.withColumn("incident_type", F.when(failed, "unknown").otherwise(incident_type(F.col("text"))))
    out = out.withColumn("urgency", F.when(failed, "unknown").otherwise(urgency_of(F.col("incident_type"))))
    out = out.withColumn("sector", F.when(failed, "manual_review").otherwise(sector_of(F.col("incident_type"))))
    out = out.withColumn("class_confidence", F.when(failed, 0.0).otherwise(CLASSIFY_CONFIDENCE))
    return out.withColumn("recipients", recipients(F.col("incident_type"), F.col("urgency"), F.col("sector")))


def outside_taxonomy(kind: Column, urgency: Column, sector: Column) -> Column:
    """Dimensions whose label isn't in the taxonomy."""
    given = {"type": kind, "urgency": urgency, "sector": sector}
    return F.array_compact(F.array(*(F.when(~given[d].isin(*labels), F.lit(d)) for d, labels in TAXONOMY.items())))
