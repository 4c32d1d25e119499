"""Explicit schemas of the three raw tables and of their landed form.

Every table is read with a declared schema, so no job pays for schema inference and
files written by different cycles cannot disagree in type.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES: dict[str, DataType] = {
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
}


def _struct(columns: str) -> StructType:
    """``name`` is a string column, ``name:type`` a typed one."""
    fields = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        fields.append(StructField(name, _TYPES[kind or "string"], True))
    return StructType(fields)


# The column order of the raw files.
EVENTS_SCHEMA = _struct("""
    GlobalEventID:long Day:int MonthYear:int Year:int FractionDate:double
    Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode
    Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code
    Actor2Code Actor2Name Actor2CountryCode Actor2KnownGroupCode Actor2EthnicCode
    Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code
    IsRootEvent:int EventCode EventBaseCode EventRootCode
    QuadClass:int GoldsteinScale:double NumMentions:int NumSources:int NumArticles:int AvgTone:double
    Actor1Geo_Type Actor1Geo_FullName Actor1Geo_CountryCode Actor1Geo_ADM1Code Actor1Geo_ADM2Code
    Actor1Geo_Lat:double Actor1Geo_Long:double Actor1Geo_FeatureID
    Actor2Geo_Type Actor2Geo_FullName Actor2Geo_CountryCode Actor2Geo_ADM1Code Actor2Geo_ADM2Code
    Actor2Geo_Lat:double Actor2Geo_Long:double Actor2Geo_FeatureID
    ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_ADM1Code ActionGeo_ADM2Code
    ActionGeo_Lat:double ActionGeo_Long:double ActionGeo_FeatureID
    DATEADDED SOURCEURL
""")

# The column order of the raw files.
MENTIONS_SCHEMA = _struct("""
    GlobalEventID:long EventTimeDate MentionTimeDate MentionType:int
    MentionSourceName MentionIdentifier SentenceID:int
    Actor1CharOffset Actor2CharOffset ActionCharOffset
    InRawText:int Confidence:int MentionDocLen:int MentionDocTone:double
    MentionDocTranslationInfo Extras
""")

# The column order of the raw files.
GKG_SCHEMA = _struct("""
    GKGRECORDID DATE SourceCollectionIdentifier SourceCommonName DocumentIdentifier
    Counts V2Counts Themes V2Themes Locations V2Locations Persons V2Persons
    Organizations V2Organizations V2Tone Dates GCAM SharingImage RelatedImages
    SocialImageEmbeds SocialVideoEmbeds Quotations AllNames Amounts TranslationInfo Extras
""")

RAW_SCHEMAS: dict[str, StructType] = {
    "events": EVENTS_SCHEMA,
    "mentions": MENTIONS_SCHEMA,
    "gkg": GKG_SCHEMA,
}

# The landing partition columns carry their own names: a partition column called like a
# data column ("day" against "Day") would silently replace the file's values.
INGEST_FIELDS = (
    StructField("landing", StringType(), True),
    StructField("ingest_ts", TimestampType(), True),
    StructField("ingest_date", DateType(), True),
    StructField("ingest_hour", IntegerType(), True),
)
PARTITION_COLUMNS = ("ingest_date", "ingest_hour")
#: The outermost partition: the landing that wrote the rows.
LANDING = "landing"


def raw_schema(table: str) -> StructType:
    """Schema of one raw table."""
    try:
        return RAW_SCHEMAS[table]
    except KeyError:
        raise ValueError(f"unknown table {table!r}; expected one of {sorted(RAW_SCHEMAS)}") from None


def landed_schema(table: str) -> StructType:
    """Raw columns followed by the landing, the ingest timestamp and the partition columns."""
    return StructType([*raw_schema(table).fields, *INGEST_FIELDS])
