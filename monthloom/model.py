"""The panel data model: schemas, source column names and code scales."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per entity and month.
PANEL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("fed", T.StringType()),
    T.StructField("sex", T.StringType()),
    T.StructField("birth_year", T.IntegerType()),
    T.StructField("tit_code", T.StringType()),
    T.StructField("wtit_code", T.StringType()),
    T.StructField("otit", T.StringType()),
    T.StructField("foa", T.StringType()),
    T.StructField("rat", T.IntegerType()),
    T.StructField("gms", T.IntegerType()),
    T.StructField("k", T.IntegerType()),
    T.StructField("flag", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("mon", T.IntegerType()),
])

PANEL_COLUMNS = tuple(PANEL_SCHEMA.fieldNames())

# Header names of the published monthly extracts.
EXTRACT_HEADER = {
    "id": "ID Number",
    "name": "Name",
    "fed": "Fed",
    "sex": "Sex",
    "birth_year": "B-day",
    "tit_code": "Tit",
    "wtit_code": "WTit",
    "otit": "OTit",
    "foa": "FOA",
    "rat": "Rat",
    "gms": "Gms",
    "k": "K",
    "flag": "Flag",
    "year": "Year",
    "mon": "Mon",
}

# Titles from lowest to highest; "no title" ranks 0.
TITLES = ("CM", "FM", "IM", "GM")
WOMEN_TITLES = ("WCM", "WFM", "WIM", "WGM")

# K factors, sexes and the flag codes left after recoding.
K_FACTORS = (10, 20, 40)
SEXES = ("F", "M")
FLAGS = ("", "i")

# Right-closed age group edges.
AGE_GROUP_EDGES = (5, 18, 25, 35, 50, 65, 75, 110)

# String columns whose NULLs become '' during cleaning.
TEXT_COLUMNS = ("name", "tit_code", "wtit_code", "otit", "foa", "flag")
