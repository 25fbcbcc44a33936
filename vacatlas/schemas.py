"""Row types and column ownership."""

from __future__ import annotations

from pyspark.sql import types as T

STRUCTURED = T.StructType([T.StructField("language_skills", T.ArrayType(T.StructType([
    T.StructField("language", T.StringType()), T.StructField("level", T.IntegerType())])))])

SIGHTING = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("provider", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("company", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("external_id", T.StringType()),
    T.StructField("posted", T.DateType()), T.StructField("description", T.StringType()),
    T.StructField("tier", T.StringType()), T.StructField("tags", T.StringType()),
    T.StructField("salary_hint", T.StringType()), T.StructField("structured", STRUCTURED),
])

RAW_PAYLOAD = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("company", T.StringType()), T.StructField("tier", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("payload", T.StringType()),
])

# columns only a person writes; a run must carry them over unchanged
HUMAN_COLUMNS = {
    "status": T.StringType(), "starred": T.BooleanType(), "hidden": T.BooleanType(),
    "notes": T.StringType(), "applied_at": T.DateType(), "follow_up_at": T.DateType(),
    "contact_person": T.StringType(), "salary_discussion": T.StringType(),
}
HUMAN_DEFAULTS = {"status": "new", "starred": False, "hidden": False, "notes": "",
                  "contact_person": "", "salary_discussion": ""}
# columns kept by the upsert itself
BOOKKEEPING = {
    "first_seen_at": T.TimestampType(), "last_seen_at": T.TimestampType(),
    "times_seen": T.IntegerType(), "is_open": T.BooleanType(), "is_new": T.BooleanType(),
    "removed_at": T.TimestampType(),
}
