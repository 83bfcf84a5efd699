"""Spelling repair of places and issuing authorities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import strip
from inkwell.rules.text_values import PLACE_SPELLINGS


def normalise_place(col: Column) -> Column:
    clean = strip(F.regexp_replace(col, r"^[:\s.\-]+|[\s,.:\-]+$", ""))
    spelling = F.create_map(*[F.lit(x) for pair in PLACE_SPELLINGS.items() for x in pair])
    return F.coalesce(F.try_element_at(spelling, clean), clean, F.lit(""))


def normalise_authority(col: Column, taluka: Column) -> Column:
    named = F.nullif(F.regexp_extract(col, r"तहसीलदार[\s:]*([A-Za-z\u0900-\u097F]+)", 1), F.lit(""))
    place = F.coalesce(normalise_place(named), F.lit(""))
    place = F.when(named.isNotNull(), place).otherwise(F.coalesce(F.when(taluka != "", normalise_place(taluka)), F.lit("")))
    title = F.rtrim(F.concat(F.lit("तहसीलदार "), place))
    return F.coalesce(F.when(col.contains("तहसीलदार"), title).otherwise(strip(col)), F.lit(""))
